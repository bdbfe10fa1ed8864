"""Queries over vectors, partitions and topics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from acervo.functions import text as T
from acervo.functions import vectors as V
from acervo.operators import neighbours, topics
from acervo.plans.registry import query, sql_norm
from acervo.runtime import cut, table

_E = "e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
_CENT = f"""with {_E}, u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as len from e),
  x as (select vec_id, label, unnest(v) / len as val, generate_subscripts(v, 1) as i from u),
  m as (select label, i, avg(val) as val from x group by label, i),
  c as (select label, list(val order by i) as cv from m group by label)"""


def _rows(spark, d):
    return table(spark, d, "embeddings")


def _asked(spark, d):
    return _rows(spark, d).where("vec_id % 100 = 0")


def centroids(rows):
    """Mean of the unit vectors of every label: one row per label, positions summed apart."""
    u = rows.select("label", F.posexplode(V.unit(F.col("embedding"))).alias("i", "x"))
    return (
        u.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))
    )


@query(
    "nearest_vectors",
    f"""with {_E}, s as (select a.vec_id as query, b.vec_id as neighbour,
      list_cosine_similarity(a.v, b.v) as similarity from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by query order by round(similarity, 12) desc, neighbour) as rank from s)
    select query, neighbour, round(similarity, 6) as similarity, rank from r where rank <= 10""",
)
def nearest_vectors(spark, d):
    """The ten nearest of every row whose id is divisible by 100, among all rows."""
    return neighbours.nearest(_asked(spark, d), _rows(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


@query(
    "mutual_neighbours",
    f"""with {_E}, s as (select a.vec_id as q, b.vec_id as n, list_cosine_similarity(a.v, b.v) as s from e a, e b where a.vec_id <> b.vec_id),
    r as (select *, row_number() over (partition by q order by round(s, 12) desc, n) as rank from s where s >= 0.3)
    select a.q as query, a.n as neighbour, round(a.s, 6) as similarity from r a join r b on a.q = b.n and a.n = b.q
    where a.rank <= 10 and b.rank <= 10 and a.q % 100 = 0""",
)
def mutual_neighbours(spark, d):
    return neighbours.mutual(_asked(spark, d), _rows(spark, d), 10, 0.3).withColumn("similarity", F.round("similarity", 6))


@query(
    "silhouettes",
    f"""with {_E}, s as (select a.vec_id as query, a.label as mine, b.label as other, avg(1 - list_cosine_similarity(a.v, b.v)) as far
      from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id group by 1, 2, 3),
    t as (select query, max(far) filter (where other = mine) as a, min(far) filter (where other <> mine) as b from s group by query)
    select query, round(coalesce((b - a) / greatest(a, b), 0), 6) as silhouette from t""",
)
def silhouettes(spark, d):
    return neighbours.silhouettes(_asked(spark, d), _rows(spark, d)).withColumn("silhouette", F.round("silhouette", 6))


@query(
    "centroid_distances",
    f"""{_CENT} select vec_id, u.label, round(1 - list_cosine_similarity(v, cv), 6) as distance from u join c using (label)""",
)
def centroid_distances(spark, d):
    rows = _rows(spark, d)
    c = centroids(rows)
    return rows.join(F.broadcast(c), "label").select(
        "vec_id", "label", F.round(1 - V.cosine(F.col("embedding"), F.col("centroid")), 6).alias("distance")
    )


@query(
    "semantic_margins",
    f"""{_CENT}, s as (select vec_id, c.label, list_cosine_similarity(v, cv) as s from u, c),
    r as (select *, row_number() over (partition by vec_id order by round(s, 10) desc, label) as k from s)
    select vec_id, max(label) filter (where k = 1) as nearest_label,
      round(max(s) filter (where k = 1) - max(s) filter (where k = 2), 6) as margin from r group by vec_id""",
)
def semantic_margins(spark, d):
    """Nearest centroid of every vector and its margin over the next: centroids travel as one array."""
    rows = _rows(spark, d)
    c = centroids(rows).agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    scored = rows.crossJoin(F.broadcast(c)).select(
        "vec_id",
        F.array_sort(
            F.transform("all", lambda x: F.struct(F.round(-V.cosine(F.col("embedding"), x["centroid"]), 10).alias("s"), x["label"].alias("label")))
        ).alias("r"),
    )
    return scored.select(
        "vec_id", F.col("r")[0]["label"].alias("nearest_label"), F.round(F.col("r")[1]["s"] - F.col("r")[0]["s"], 6).alias("margin")
    )


@query(
    "central_vectors",
    f"""{_CENT}, s as (select u.label, vec_id, list_cosine_similarity(v, cv) as s from u join c using (label)),
    r as (select *, row_number() over (partition by label order by round(s, 10) desc, vec_id) as rank from s)
    select label, vec_id, rank from r where rank <= 10""",
)
def central_vectors(spark, d):
    rows = _rows(spark, d)
    s = rows.join(F.broadcast(centroids(rows)), "label").withColumn("s", F.round(V.cosine(F.col("embedding"), F.col("centroid")), 10))
    w = Window.partitionBy("label").orderBy(F.col("s").desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("label", "vec_id", "rank")


@query(
    "label_dispersion",
    f"""{_CENT} select u.label, count(*) as n, round(avg(1 - list_cosine_similarity(v, cv)), 6) as dispersion,
      round(quantile_cont(1 - list_cosine_similarity(v, cv), 0.9), 6) as p90 from u join c using (label) group by u.label""",
)
def label_dispersion(spark, d):
    rows = _rows(spark, d)
    far = 1 - V.cosine(F.col("embedding"), F.col("centroid"))
    return (
        rows.join(F.broadcast(centroids(rows)), "label").select("label", far.alias("x")).groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("dispersion"), F.round(F.percentile("x", F.lit(0.9)), 6).alias("p90"))
    )


@query(
    "lang_entropy",
    """with n as (select source, lang, count(*) as n from documents where lang is not null and source is not null group by 1, 2),
    p as (select source, n / sum(n) over (partition by source) as p from n)
    select source, round(case when count(*) > 1 then sum(-p * ln(p)) end, 6) as entropy, count(*) as categories from p group by source""",
)
def lang_entropy(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return topics.entropy(docs, ["source"], "lang").withColumn("entropy", F.round("entropy", 6))


@query(
    "dominant_language",
    """with n as (select source, lang, count(*) as n from documents group by 1, 2),
    w as (select *, sum(n) over (partition by source) as total, sum(case when lang is not null then n else 0 end) over (partition by source) as known from n),
    r as (select *, row_number() over (partition by source order by n desc, lang) as r from w where lang is not null)
    select source, lang as dominant, round(n / known, 6) as share, round(known / total, 6) as coverage from r where r = 1""",
)
def dominant_language(spark, d):
    return topics.dominant(table(spark, d, "documents"), ["source"], "lang").withColumn("share", F.round("share", 6)).withColumn("coverage", F.round("coverage", 6))


@query(
    "partition_agreement",
    """with t as (select lang, doc_kind, count(*)::double as n from documents where lang is not null and doc_kind is not null group by 1, 2),
    a as (select lang, sum(n) as n from t group by 1), b as (select doc_kind, sum(n) as n from t group by 1), z as (select sum(n) as total from t),
    q as (select sum(t.n * (t.n - 1) / 2) as sij, sum(t.n / total * ln(t.n * total / (a.n * b.n))) as mi
      from t join a using (lang) join b using (doc_kind), z),
    x as (select sum(n * (n - 1) / 2) as sa, sum(-n / total * ln(n / total)) as ha from a, z),
    y as (select sum(n * (n - 1) / 2) as sb, sum(-n / total * ln(n / total)) as hb from b, z)
    select total::bigint as n, round((sij - sa * sb / (total * (total - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (total * (total - 1) / 2)), 6) as ari,
      round(mi / ((ha + hb) / 2), 6) as nmi from q, x, y, z""",
)
def partition_agreement(spark, d):
    got = topics.agreement(table(spark, d, "documents"), "lang", "doc_kind")
    return got.withColumn("ari", F.round("ari", 6)).withColumn("nmi", F.round("nmi", 6))


_TOK = rf"""tok as (select doc_id, doc_kind as topic, unnest(string_split({sql_norm('text')}, ' ')) as term from documents where text is not null and doc_kind is not null),
  t0 as (select topic, term, count(*) as tf from tok where length(term) >= 4 group by 1, 2),
  d0 as (select term, count(*) as df from t0 group by 1),
  w0 as (select topic, term, (1 + ln(tf)) * (ln((1 + (select count(distinct topic) from t0)) / (1 + df)) + 1) as w from t0 join d0 using (term)),
  w1 as (select topic, term, w / sqrt(sum(w * w) over (partition by topic)) as weight from w0),
  terms as (select * from (select *, row_number() over (partition by topic order by round(weight, 10) desc, term) as rank from w1) where rank <= 10)"""


def _tokens(spark, d):
    docs = table(spark, d, "documents").where("text is not null and doc_kind is not null")
    return docs.select("doc_id", F.col("doc_kind").alias("topic"), F.explode(F.split(T.norm("text"), " ")).alias("term")).where("length(term) >= 4")


def _terms(spark, d):
    return topics.class_terms(_tokens(spark, d), 10)


@query("class_terms", f"with {_TOK} select topic, term, round(weight, 6) as weight, rank from terms")
def class_terms(spark, d):
    return _terms(spark, d).withColumn("weight", F.round("weight", 6))


@query("topic_diversity", f"with {_TOK} select round(count(distinct term) / count(*), 6) as diversity from terms")
def topic_diversity(spark, d):
    return topics.diversity(_terms(spark, d)).withColumn("diversity", F.round("diversity", 6))


@query(
    "lexical_metrics",
    f"""with {_TOK}, o as (select *, count(*) over (partition by term) as topics, weight / sum(weight) over (partition by topic) as p from terms),
    own as (select topic, avg((topics = 1)::int) as unique_share, sum(-p * ln(p)) as term_entropy, count(*) as n from o group by topic),
    pr as (select a.topic, b.topic as other, count(*) as c from terms a join terms b on a.term = b.term and a.topic <> b.topic group by 1, 2),
    j as (select pr.topic, sum(c / (x.n + y.n - c)) as sj, max(c / (x.n + y.n - c)) as mj from pr join own x on x.topic = pr.topic join own y on y.topic = other group by 1)
    select own.topic, round(unique_share, 6) as unique_share, round(term_entropy, 6) as term_entropy,
      round(coalesce(sj, 0) / ((select count(*) from own) - 1), 6) as mean_similarity, round(coalesce(mj, 0), 6) as max_similarity
    from own left join j on j.topic = own.topic""",
)
def lexical_metrics(spark, d):
    got = topics.lexical_metrics(cut(_terms(spark, d)))
    return got.select("topic", *[F.round(c, 6).alias(c) for c in ("unique_share", "term_entropy", "mean_similarity", "max_similarity")])


@query(
    "topic_coherence",
    f"""with {_TOK}, h as (select distinct doc_id, term from tok where term in (select term from terms)),
    df as (select term, count(*) as df from h group by 1),
    co as (select a.term as ta, b.term as tb, count(*) as c from h a join h b on a.doc_id = b.doc_id and a.term <> b.term group by 1, 2)
    select a.topic, round(avg(ln((coalesce(c, 0) + 1) / df)), 6) as umass from terms a join terms b on a.topic = b.topic and a.rank > b.rank
    join df on df.term = b.term left join co on co.ta = a.term and co.tb = b.term group by a.topic""",
)
def topic_coherence(spark, d):
    tokens = _tokens(spark, d).select(F.col("doc_id").alias("document_id"), "term").distinct()
    return topics.umass(cut(_terms(spark, d)), tokens).withColumn("umass", F.round("umass", 6))


@query(
    "topic_alignment",
    """with b as (select doc_kind as left_topic, lang as right_topic, count(*) as overlap from documents where doc_kind is not null and lang is not null group by 1, 2),
    j as (select *, overlap / (sum(overlap) over (partition by left_topic) + sum(overlap) over (partition by right_topic) - overlap) as jaccard from b),
    k as (select *, max(jaccard) over (partition by left_topic) as bl, max(jaccard) over (partition by right_topic) as br from j)
    select left_topic, right_topic, overlap, round(jaccard, 6) as jaccard, case when jaccard = bl and jaccard = br and jaccard >= 0.15 then 'one_to_one'
      when jaccard = bl and jaccard >= 0.08 then 'split' when jaccard = br and jaccard >= 0.08 then 'combined'
      when jaccard >= 0.05 then 'partial' else 'weak' end as relation from k""",
)
def topic_alignment(spark, d):
    docs = table(spark, d, "documents")
    left = docs.where("doc_kind is not null").select(F.col("doc_id").alias("document_id"), F.col("doc_kind").alias("topic"))
    right = docs.where("lang is not null").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("topic"))
    return topics.align(left, right).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "topics_over_time",
    """with n as (select doc_kind as topic, publication_year as year, count(*) as n from documents where doc_kind is not null and publication_year is not null group by 1, 2),
    y as (select year, sum(n)::bigint as in_year from n group by 1)
    select t.topic, y.year, coalesce(n, 0) as n, in_year, round(coalesce(n, 0) / in_year, 6) as share
    from (select distinct topic from n) t cross join y left join n on n.topic = t.topic and n.year = y.year""",
)
def topics_over_time(spark, d):
    return topics.over_time(table(spark, d, "documents"), "doc_kind", "publication_year").withColumn("share", F.round("share", 6))


@query(
    "excess_share",
    """with n as (select doc_kind, lang, count(*) as n from documents where doc_kind is not null and lang is not null group by 1, 2)
    select doc_kind, lang, round(n / sum(n) over (partition by doc_kind) - sum(n) over (partition by lang) / sum(n) over (), 6) as excess from n""",
)
def excess_share(spark, d):
    n = table(spark, d, "documents").where("doc_kind is not null and lang is not null").groupBy("doc_kind", "lang").agg(F.count(F.lit(1)).alias("n"))
    of = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    return n.select("doc_kind", "lang", F.round(F.col("n") / of("doc_kind") - of("lang") / of(), 6).alias("excess"))


@query(
    "minmax_scores",
    """with s as (select source, avg(n_chars) as m from documents where source is not null group by 1)
    select source, round((m - min(m) over ()) / (max(m) over () - min(m) over ()), 6) as score from s""",
)
def minmax_scores(spark, d):
    s = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.avg("n_chars").alias("m"))
    lo, hi = F.min("m").over(Window.partitionBy()), F.max("m").over(Window.partitionBy())
    return s.select("source", F.round((F.col("m") - lo) / (hi - lo), 6).alias("score"))


@query(
    "ambiguous_vectors",
    f"""{_CENT}, s as (select vec_id, u.label as own, c.label, list_cosine_similarity(v, cv) as s from u, c),
    r as (select vec_id, own, max(s) filter (where label = own) as p, max(s) filter (where label <> own) as q from s group by 1, 2)
    select own as label, count(*) filter (where p - q < 0.05 or p < 0.3) as ambiguous, count(*) as n from r group by own""",
)
def ambiguous_vectors(spark, d):
    rows = _rows(spark, d)
    c = centroids(rows).agg(F.collect_list(F.struct("label", "centroid")).alias("all"))
    sims = F.transform("all", lambda x: F.struct(x["label"].alias("label"), V.cosine(F.col("embedding"), x["centroid"]).alias("s")))
    r = rows.crossJoin(F.broadcast(c)).select("label", sims.alias("s"))
    p = F.array_max(F.transform(F.filter("s", lambda x: x["label"] == F.col("label")), lambda x: x["s"]))
    q = F.array_max(F.transform(F.filter("s", lambda x: x["label"] != F.col("label")), lambda x: x["s"]))
    flag = topics.ambiguity(p - q, p, 0.05, 0.3)
    return r.select("label", flag.alias("f")).groupBy("label").agg(F.count_if("f").alias("ambiguous"), F.count(F.lit(1)).alias("n"))
