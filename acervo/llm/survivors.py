"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Every row of a group votes, through its source, for the values it holds. The odds of a value
in a group are its prior and its votes. A vote weighs by the accuracy of its source and
by how rarely false votes fall on that value. A value is true of one work at most, and a work has
one true value: the odds compete with those of the group's other values and with those of
the same value in all other groups, so what many works hold (a deposit notice, a
placeholder) is true of none. Sources that share more false values than chance explains are
dependent; of dependent sources that vote alike only the most accurate counts in full, the
others in the share that they are not copies.

Accuracies, dependence, the popularity of false values and the priors (by the number of
groups that hold a value) are all estimated from the data and from each other, until the
accuracies change by less than ``SETTLED``. The value of maximum posterior survives, field by
field, if it reaches ``LEAST_POSTERIOR``.

For the DOI the data state which of several true values is current: the one of the row
updated last; votes decide among rows of that very time. For the abstract, cut copies vote
for the full text they begin, and the most complete row of the winning text is kept. Texts
are told apart by all their letters; a cut that begins several texts votes for the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acervo.runtime import cut, known, table

#: The estimates stop when no accuracy changes by more, or after so many rounds.
SETTLED, MOST_ROUNDS = 0.01, 6
LEAST_POSTERIOR = 0.4
#: A text of fewer characters is no abstract.
SHORT_CHARS = 40
#: A false vote falls on any one value with this probability at least.
FALSE_SHARE = 0.05
START_ACCURACY = 0.7
#: Share of shared values that a copier is taken to copy.
COPY_SHARE = 0.8
#: Letters from which on a text of another group is taken to be cut from, or to continue, this one.
HEAD = 60


def doi_form(column: Column) -> Column:
    """The DOI in lower case without prefix where it is well formed, NULL otherwise."""
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^(?:doi:?\s*|https?://[^/\s]+/)+", "")
    return F.when(bare.rlike(r"^10\.\d{4,9}/[-._;()/:a-z0-9]*[a-z0-9]$"), bare)


def _core(column: Column) -> Column:
    """A text without an ellipsis at its end, and once where it is written twice."""
    text = F.regexp_replace(F.trim(column), r"\s*(?:\.\.\.|…|\[\s*(?:\.\.\.|…)\s*\])$", "")
    text_half = F.substring(text, F.lit(1), F.floor(F.length(text) / 2).cast("int"))
    doubled = F.trim(text) == F.concat(F.trim(text_half), F.trim(text_half))
    spaced = F.trim(text) == F.concat(F.trim(text_half), F.lit(" "), F.trim(text_half))
    return F.when(doubled | spaced, F.trim(text_half)).otherwise(text)


def _letters(column: Column) -> Column:
    return F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", "")


def _whole(letters: Column, *within: str) -> Column:
    """Of a text, the first text that it begins and that begins no other, among those of ``within``.

    In the order of texts a beginning stands before all that it begins.
    """
    order = Window.partitionBy(*within).orderBy(letters)
    after = F.lead(letters).over(order)
    ends = F.when(after.isNull() | ~F.startswith(after, letters), letters)
    return F.first(ends, ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))


def with_values(rows: DataFrame) -> DataFrame:
    """``rows`` (``g, core, letters``) with the whole ``text`` of its group that a row's abstract is or begins, and that text's ``value``.

    Rows without an abstract of ``SHORT_CHARS`` characters have neither; one without letters
    begins nothing.
    """
    told = rows.withColumn("_told", F.when((F.length("core") >= SHORT_CHARS) & (F.col("letters") != ""), F.col("letters")))
    text = F.when(F.col("_told").isNotNull(), F.col("_text")).when(F.length("core") >= SHORT_CHARS, F.lit(""))
    told = told.withColumn("_lacks", F.col("_told").isNull()).withColumn("_text", _whole(F.col("_told"), "g", "_lacks"))
    # told by all letters, in the order of the first ones
    value = F.concat(F.substring("text", 1, HEAD), F.lit(" "), F.md5("text"))
    return told.withColumn("text", text).withColumn("value", value).drop("_told", "_lacks", "_text")


def _votes(rows: DataFrame) -> DataFrame:
    """``g, source, field, value, key, bin``: one row per vote; ``key`` is the value told from those of all
    groups, ``bin`` the doublings of the number of groups that hold it.

    An abstract counts as held by every group with a text that is, begins or continues it;
    of less than ``HEAD`` letters, by those with the very text.
    """
    doi = rows.where("doi is not null").select("g", "source", F.lit("doi").alias("field"), F.col("doi").alias("value"), F.xxhash64("doi").alias("key"))
    spread = doi.groupBy("value").agg(F.countDistinct("g").alias("groups"))
    doi = doi.distinct().join(spread, "value")
    text = rows.where("value is not null").select("g", "source", "value", "text")
    held = text.select("g", "value", "text").distinct().withColumn("head", F.substring("text", 1, HEAD))
    held = held.withColumn("key", F.xxhash64(_whole(F.col("text"), "head"))).select("g", "value", "key")
    spread = held.join(held.groupBy("key").agg(F.countDistinct("g").alias("groups")), "key")
    abstract = text.select("g", "source", F.lit("abstract").alias("field"), "value").distinct().join(spread, ["g", "value"])
    columns = ("g", "source", "field", "value", "key", "groups")
    return doi.select(*columns).unionByName(abstract.select(*columns)).withColumn("bin", F.ceil(F.log2("groups")).cast("int"))


def _posterior(accuracy: DataFrame, copies: DataFrame, learned: DataFrame) -> DataFrame:
    """``g, field, value, posterior``: the probability of every value after the discounted votes.

    ``learned`` are the votes with their ``prior`` and the ``share`` of false votes that fall on their value.
    """
    weighed = learned.join(accuracy, "source").withColumn("weight", F.log(F.col("accuracy") / (1 - F.col("accuracy"))) - F.log(F.greatest("share", F.lit(FALSE_SHARE))))
    # a vote counts in the share not copied from any more accurate source that votes alike
    other = weighed.select("g", "field", "value", F.col("source").alias("other"), F.col("accuracy").alias("theirs"))
    alone = (
        weighed.join(other, ["g", "field", "value"])
        .where("theirs > accuracy or (theirs = accuracy and other < source)")
        .join(copies, ["source", "other"])
        .groupBy("g", "field", "value", "source")
        .agg(F.exp(F.sum(F.log(1 - F.lit(COPY_SHARE) * F.col("copy")))).alias("alone"))
    )
    odds = cut(
        weighed.join(alone, ["g", "field", "value", "source"], "left")
        .groupBy("g", "field", "value", "key")
        .agg((F.first("prior") + F.sum(F.col("weight") * F.coalesce("alone", F.lit(1.0)))).alias("score"))
        .withColumn("odds", F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score")))))
    )
    within = odds.groupBy("g", "field").agg(F.sum("odds").alias("of_work"))
    across = odds.groupBy("field", "key").agg(F.sum("odds").alias("of_value"))
    return (
        odds.join(within, ["g", "field"])
        .join(across, ["field", "key"])
        .select("g", "field", "value", (F.col("odds") / (1 + F.col("of_work") + F.col("of_value") - F.col("odds"))).alias("posterior"))
    )


def _estimate(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From votes with their ``posterior``: accuracies, copy probabilities, priors by bin, shares of false votes."""
    accuracy = judged.groupBy("source").agg(
        F.greatest(F.lit(0.05), F.least(F.lit(0.95), (F.sum("posterior") + 7.0) / (F.count(F.lit(1)) + 10.0))).alias("accuracy")
    )
    values = judged.select("g", "field", "value", "bin", "posterior").distinct()
    priors = values.groupBy("field", "bin").agg(F.log((F.sum("posterior") + 1) / (F.sum(1 - F.col("posterior")) + 1)).alias("prior"))
    false = judged.groupBy("field", "key").agg(F.sum(1 - F.col("posterior")).alias("n"))
    total = false.groupBy("field").agg((F.sum("n") + 1).alias("all"))
    shares = false.join(total, "field").select("field", "key", (F.col("n") / F.col("all")).alias("share"))
    mine = judged.join(shares, ["field", "key"]).select("g", "field", "source", "value", F.col("posterior").alias("p"), "share")
    theirs = mine.select("g", "field", F.col("source").alias("other"), F.col("value").alias("v2"))
    chance = (1 - F.col("accuracy")) * F.greatest("share", F.lit(FALSE_SHARE))
    alike = (1 - F.col("p")) * (F.log(F.lit(COPY_SHARE) + (1 - F.lit(COPY_SHARE)) * chance) - F.log(chance))
    # log likelihood ratio of copying against independence
    llr = (
        mine.join(theirs, ["g", "field"])
        .where("source <> other")
        .join(accuracy, "source")
        .groupBy("source", "other")
        .agg(F.sum(F.when(F.col("value") == F.col("v2"), alike).otherwise(F.log(F.lit(1 - COPY_SHARE)))).alias("llr"))
    )
    copies = llr.select("source", "other", (1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), "llr"))))).alias("copy"))
    return accuracy, copies, priors, shares


def fuse(votes: DataFrame) -> DataFrame:
    """``g, field, value, posterior`` after estimates that no longer change."""
    spark = votes.sparkSession
    accuracy = votes.select("source").distinct().withColumn("accuracy", F.lit(START_ACCURACY))
    copies = spark.createDataFrame([], "source string, other string, copy double")
    learned = votes.withColumns({"prior": F.lit(0.0), "share": F.lit(FALSE_SHARE)})
    for _ in range(MOST_ROUNDS):
        posterior = _posterior(accuracy, copies, learned)
        judged = cut(votes.join(posterior, ["g", "field", "value"]))
        now, copies, priors, shares = _estimate(judged)
        now, copies = cut(now), cut(copies)
        learned = cut(votes.join(priors, ["field", "bin"]).join(shares, ["field", "key"]))
        moved = now.join(accuracy.withColumnRenamed("accuracy", "was"), "source").agg(F.max(F.abs(F.col("accuracy") - F.col("was")))).first()[0]
        accuracy = now
        if moved is None or moved < SETTLED:
            break
    return _posterior(accuracy, copies, learned)


def survivors(corpus: DataFrame) -> DataFrame:
    """One row per duplicate group: ``duplicate_group_id, doi_normalized, document_id``.

    Rows without a group are left out. Null, blank and null-token values do not vote; a
    group without a well-formed DOI or without a real abstract gets ``''``; rows without
    a source vote as one unnamed source, rows without a time count as oldest; ties go to
    the later row and then to the lesser value; repeated rows change nothing; texts of any
    length are compared whole; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = (
        corpus.where("duplicate_group_id is not null")
        .select(
            F.col("duplicate_group_id").alias("g"),
            "document_id",
            F.coalesce(known("source_database"), F.lit("")).alias("source"),
            F.coalesce("updated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"),
            doi_form(known("doi_normalized")).alias("doi"),
            _core(known("abstract")).alias("core"),
        )
        .distinct()
        .withColumn("letters", _letters(F.col("core")))
    )
    rows = cut(with_values(rows).drop("letters"))
    votes = cut(_votes(rows))
    posterior = cut(fuse(votes))
    dois = (
        rows.where("doi is not null")
        .join(posterior.where("field = 'doi'"), (rows["doi"] == posterior["value"]) & (rows["g"] == posterior["g"]))
        .groupBy(rows["g"])
        .agg(F.max_by("doi", F.struct("at", "posterior", "doi")).alias("doi_normalized"))
    )
    texts = (
        rows.where("core is not null")
        .join(
            posterior.where(f"field = 'abstract' and posterior >= {LEAST_POSTERIOR}"),
            (rows["value"] == posterior["value"]) & (rows["g"] == posterior["g"]),
        )
        .groupBy(rows["g"])
        .agg(
            F.max_by(
                "document_id", F.struct("posterior", rows["value"], F.length("core").alias("n"), "at", "document_id")
            ).alias("document_id")
        )
    )
    return (
        rows.select("g")
        .distinct()
        .join(dois, "g", "left")
        .join(texts, "g", "left")
        .select(
            F.col("g").alias("duplicate_group_id"),
            F.coalesce("doi_normalized", F.lit("")).alias("doi_normalized"),
            F.coalesce("document_id", F.lit("")).alias("document_id"),
        )
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving DOI and the row of the surviving abstract of every duplicate group."""
    return survivors(table(spark, sf_dir, "corpus_builder"))
