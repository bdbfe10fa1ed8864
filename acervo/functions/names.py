"""Names of people and organisations: shape tests shared by parsing and matching."""

from __future__ import annotations

import re
import unicodedata

#: Given names common in the five languages of the collections.
GIVEN_NAMES = frozenset(
    """
    adrian alberto alejandro alice alicia ana andre andrea andres andrew anna anne anthony antoine antonio
    arthur beatriz benito benjamin bernard bruno camila carla carlos carmen catherine cecilia charles
    christopher claire clara claudia cristina daniel david deborah diana diego dolores eduardo edward elena elisa
    elizabeth emilia emilio emma enrique ernesto esteban eva felipe fernanda fernando francis
    francisco francois gabriel gabriela george gloria gonzalo graciela guadalupe guillermo
    gustavo hector helena henri henry hugo ignacio ines irene isabel ivan jaime james javier jennifer
    jean jesus joan joao joaquin john jorge jose josefa joseph juan julia julian julie julio karim
    karina laura leonardo leticia lia lidia louis lourdes lucas lucia luis luisa luiz manuel
    marc marcela marcelo marcos margaret margarita maria marie mario marta martha martin mary
    mateo matias matthew mercedes michael miguel monica natalia nicholas nicolas noemi olga oscar pablo patricia
    paul paula paulo pedro peter philippe pierre pilar putri rafael ramon raul rebeca rebecca ricardo
    richard robert roberto rocio rosa rosario ruth samuel sandra santiago sara sergio silvia
    siti sofia sonia stephen susan susana teresa thomas timothy tomas ursula valentina vanessa veronica vicente
    victor victoria virginia wanda william xavier ximena yolanda zoe
    """.split()
)

#: Short, pet and abbreviated forms, with the names they stand for.
NICKNAMES = {
    "ale": ("alejandro",), "alej": ("alejandro",), "alex": ("alejandro",), "alejo": ("alejandro",), "ant": ("antonio",),
    "tono": ("antonio",), "toni": ("antonio",), "toninho": ("antonio",), "tony": ("antonio",),
    "bea": ("beatriz",), "beti": ("beatriz",), "bia": ("beatriz",), "betty": ("elizabeth",), "beth": ("elizabeth",),
    "eli": ("elizabeth",), "liz": ("elizabeth",), "lisa": ("elizabeth",), "eliz": ("elizabeth",), "lizzie": ("elizabeth",),
    "bill": ("william",), "will": ("william",), "wm": ("william",), "billy": ("william",),
    "bob": ("robert",), "rob": ("robert",), "robt": ("robert",), "bobby": ("robert",),
    "cate": ("catherine",), "kate": ("catherine",), "cathy": ("catherine",), "kathy": ("catherine",), "cath": ("catherine",),
    "charo": ("rosario",), "chayo": ("rosario",), "chela": ("graciela",), "gra": ("graciela",),
    "fda": ("fernanda",), "fer": ("fernanda",), "nanda": ("fernanda",), "fco": ("francisco",), "paco": ("francisco",),
    "pancho": ("francisco",), "chico": ("francisco",), "kiko": ("francisco",), "fran": ("francisco",),
    "gpe": ("guadalupe",), "lupe": ("guadalupe",), "lupita": ("guadalupe",), "hec": ("hector",), "tito": ("hector",),
    "igna": ("ignacio",), "nacho": ("ignacio",), "ign": ("ignacio",), "joaq": ("joaquin",), "quim": ("joaquin",),
    "quino": ("joaquin",), "jse": ("jose",), "pepe": ("jose",), "ze": ("jose",), "lola": ("dolores",), "loli": ("dolores",),
    "lu": ("lucia",), "lucy": ("lucia",), "luci": ("lucia",), "luchi": ("lucia",), "mnl": ("manuel",), "manolo": ("manuel",), "manu": ("manuel",),
    "marg": ("margaret",), "maggie": ("margaret",), "meg": ("margaret",), "peggy": ("margaret",), "mar": ("maria",),
    "ma": ("maria",), "quique": ("enrique",), "kike": ("enrique",), "tom": ("tomas",), "tomy": ("tomas",), "tommy": ("tomas",), "thomas": ("tomas",),
    "vero": ("veronica",), "xavi": ("xavier",), "javi": ("xavier", "javier"), "yoli": ("yolanda",), "yola": ("yolanda",),
    "steve": ("stephen",), "steven": ("stephen",), "andy": ("andrew",), "dan": ("daniel",), "danny": ("daniel",), "mike": ("michael",),
    "jim": ("james",), "jimmy": ("james",), "jack": ("john",), "johnny": ("john",), "joe": ("joseph",), "sam": ("samuel",),
    "ben": ("benjamin",), "nick": ("nicholas",), "chris": ("christopher",), "matt": ("matthew",), "greg": ("gregory",),
    "ed": ("edward",), "eddie": ("edward",), "ted": ("edward",), "dave": ("david",), "rick": ("richard",), "dick": ("richard",),
    "chuck": ("charles",), "charlie": ("charles",), "sue": ("susan",), "suzy": ("susan",), "jenny": ("jennifer",), "jen": ("jennifer",),
    "becky": ("rebecca",), "debbie": ("deborah",), "pam": ("pamela",), "tim": ("timothy",), "jeff": ("jeffrey",), "ken": ("kenneth",),
    "ron": ("ronald",), "don": ("donald",), "larry": ("lawrence",), "fred": ("frederick",), "gus": ("gustavo",), "rafa": ("rafael",),
    "santi": ("santiago",), "edu": ("eduardo",), "guille": ("guillermo",), "memo": ("guillermo",), "beto": ("alberto",),
}

#: Particles of surnames.
PARTICLES = frozenset("de la del los las dos das do da di van von der den y e".split())

#: Words that head the name of an organisation, with abbreviations.
ORGANISATION_HEADS = (
    "centro ctro centre center instituto institute institut grupo group groupe gr observatorio "
    "observatory observatoire obs inst universidad university universidade université facultad "
    "faculty departamento department ministerio ministry escuela school red network asociación "
    "association fundación foundation laboratorio laboratory"
).split()

_HEAD = r"(?:" + "|".join(ORGANISATION_HEADS) + r")\b\.?"
_WORD = r"[^\W\d_][\w.’'-]*"
_TOPICS = rf"(?:\s+(?:de|del|for|on|of|sobre)(?:\s+(?:la|el|los|las))?\s+{_WORD}(?:,\s+{_WORD})*\s+(?:y|and|e|et)\s+{_WORD})"
_ORGANISATION = re.compile(
    rf"(?<!\w)(?:{_HEAD}(?:\s+(?!(?:y|and|e|et|&)\s){_WORD}?)*?{_TOPICS}(?:\s+{_WORD})*"
    rf"|{_WORD}\s+{_HEAD}{_TOPICS})",
    re.IGNORECASE,
)
_IS_ORGANISATION = re.compile(rf"(?<!\w){_HEAD}(?!\w)", re.IGNORECASE)


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def organisation_span(text: str) -> list[tuple[int, int]]:
    """Places of organisation names whose own commas or conjunctions separate nothing."""
    return [m.span() for m in _ORGANISATION.finditer(text)]


def is_organisation(text: str) -> bool:
    """Whether a name holds a word that heads organisations."""
    return _IS_ORGANISATION.search(text) is not None


def _one_off(word: str, names: frozenset[str]) -> bool:
    if len(word) < 4:
        return False
    for name in names:
        if abs(len(name) - len(word)) <= 1 and name[0] == word[0] and _near(word, name):
            return True
    return False


def _near(a: str, b: str) -> bool:
    """One substitution, insertion, deletion or swap of neighbours apart at most."""
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1][:2] and len(x) > 1 and x[2:] == y[2:])


def looks_given(text: str) -> bool:
    """Whether every word is a given name, a short form of one, or an initial."""
    words = [w for w in re.split(r"[\s.-]+", plain(text)) if w]
    return bool(words) and all(
        len(w) == 1 or w in GIVEN_NAMES or w in NICKNAMES or _one_off(w, GIVEN_NAMES) for w in words
    )
