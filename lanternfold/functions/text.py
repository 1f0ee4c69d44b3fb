"""Scalar text functions: normalising, tokens, titles, excerpts, answers and rule tables, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content.
STOPWORDS = (
    "a an and are as at be both by did do does for from how in is many of on or the to was were what when where which who whom whose with"
).split()

#: Endpoints that name nothing in particular.
WEAK_ENDPOINTS = (
    "he", "she", "it", "they", "him", "her", "them", "the river", "the city", "the town", "the village", "the state", "the country", "the region", "the province",
    "the district", "the county", "the company", "the club", "the team", "the band", "the film", "the album", "the song", "the book", "the novel", "the play",
    "the church", "the cathedral", "the school", "the university", "the station", "the airport", "the building", "the series",
)

#: Ordinals and suffixes of the stemmer, in the order tried.
ORDINALS = {"1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth", "5th": "fifth", "6th": "sixth", "7th": "seventh", "8th": "eighth", "9th": "ninth", "10th": "tenth"}
SUFFIXES = ("ing", "ied", "ed", "ers", "er", "ors", "or", "s")

#: Relation families and the substrings that give them, in order.
RELATION_FAMILIES = {
    "birth": ("born", "birth"),
    "death": ("died", "death"),
    "release": ("release", "released", "publish", "published"),
    "establish": ("establish", "founded", "found", "formed", "created"),
    "start": ("start", "started", "begin", "began", "commence"),
    "end": ("end", "ended", "disestablish", "abolish", "dissolve", "cease"),
    "location": ("located", "country", "county", "city", "capital", "headquarter", "part of", "contains", "empty into", "mouth"),
    "agent_role": ("written by", "created by", "directed by", "performed by", "played by", "starring", "director", "writer", "performer", "actor", "singer", "composer", "producer"),
    "spouse": ("married", "spouse", "husband", "wife"),
    "kinship": ("father", "mother", "child", "son", "daughter"),
    "count": ("number", "count", "episodes", "season", "times"),
}
LOCATION_WORDS = ("in", "at", "from", "within", "is in", "was in")

#: Phrases of comparison and state, and the slot value that each gives, in order.
COMPARISON_PHRASES = (
    ("born earlier", "earlier"), ("born later", "later"), ("died earlier", "earlier"), ("died later", "later"), ("born first", "earlier"), ("died first", "earlier"),
    ("born second", "later"), ("died second", "later"), ("older than", "older"), ("younger than", "younger"), ("older", "older"), ("younger", "younger"),
    ("earlier", "earlier"), ("later", "later"), ("lowest batting average", "lowest"), ("lowest", "lowest"), ("highest", "highest"), ("largest", "largest"),
    ("smallest", "smallest"), ("wettest", "wettest"), ("most populous", "most-populous"), ("most games", "most-games"), ("majority party", "majority"),
    ("minority party", "minority"), ("same nationality", "same-nationality"), ("same country", "same-country"), ("same state", "same-state"),
    ("second pick", "second-pick"), ("first pick", "first-pick"), ("top ranking", "top-ranking"), ("only group larger", "only-larger"),
    ("gain control", "control-gained"), ("gained control", "control-gained"),
)
#: Phrases of roles.
ROLE_PHRASES = (
    ("director", "director"), ("direct by", "director"), ("composer", "composer"), ("music by", "composer"), ("producer", "producer"), ("produced by", "producer"),
    ("writer", "writer"), ("written by", "writer"), ("designer", "designer"), ("designed by", "designer"), ("performer", "performer"), ("performed by", "performer"),
    ("governor", "governor"), ("speaker", "speaker"), ("archbishop", "archbishop"), ("explorer", "explorer"), ("husband", "husband"), ("wife", "wife"),
    ("father", "father"), ("mother", "mother"), ("child in law", "child-in-law"), ("child of", "child"), ("son of", "child"), ("daughter of", "child"),
    ("queen to", "spouse"), ("king to", "spouse"), ("married to", "spouse"), ("step of", "step-relation"),
)
#: Phrases of time and of place.
TIME_PHRASES = (
    ("born", "born"), ("died", "died"), ("death", "died"), ("created", "created"), ("established", "established"), ("abolished", "abolished"),
    ("before death", "before-death"), ("before his death", "before-death"), ("before her death", "before-death"), ("after death", "after-death"), ("reach", "reached"), ("reached", "reached"),
)
GEO_PHRASES = (
    ("north of", "north-of"), ("south of", "south-of"), ("east of", "east-of"), ("west of", "west-of"), ("adjacent to", "adjacent"), ("adjacent", "adjacent"),
    ("shares a border", "border"), ("border", "border"), ("between", "between"), ("near", "near"), ("empty into", "empties-into"),
)
#: Phrases that say along which axis things are compared.
AXIS_PHRASES = (
    ("nationality", "nationality"), ("citizen of", "nationality"), ("citizenship", "nationality"), ("same country", "nationality"), ("same nationality", "nationality"),
    ("majority", "control"), ("minority", "control"), ("gain control", "control"), ("gained control", "control"), ("control", "control"), ("population", "population"),
    ("most populous", "population"), ("largest populated", "population"), ("largest", "population"), ("wettest", "precipitation"), ("batting average", "batting-average"),
    ("draft", "draft-order"), ("pick", "draft-order"), ("games", "games-played"), ("group larger", "organization-size"), ("record label", "organization-size"),
)

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words(text: Column) -> Column:
    """The non-empty pieces of a text between blanks."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def processed(text: Column) -> Column:
    """Lower case; all but ASCII letters, digits and blanks becomes a blank; trimmed. Runs of blanks inside stay."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", " "))


def graph_text(text: Column) -> Column:
    """``processed`` with runs of blanks as one."""
    return F.regexp_replace(processed(text), " +", " ")


def normalised(text: Column) -> Column:
    """Lower case; runs of all but ASCII letters and digits become one blank; trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def content_tokens(text: Column) -> Column:
    """The distinct tokens of three letters or more that are no stopwords, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalised(text), " "), lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS)))


def informative_endpoint(text: Column) -> Column:
    """The normalised endpoint; empty if it is weak, or shorter than three letters and no number."""
    t = normalised(text)
    return F.when(t.isin(*WEAK_ENDPOINTS) | ((F.length(t) < 3) & ~t.rlike("^[0-9]+$")), "").otherwise(t)


def title_of(text: Column) -> Column:
    """The first line, trimmed."""
    return F.trim(F.substring_index(text, "\n", 1))


def body_of(text: Column) -> Column:
    """What follows the first line, without blanks, colons and dashes at its ends."""
    return F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.instr(text, "\n") + 1, F.length(text)), "^[ \\t\\n\\r:-]+|[ \\t\\n\\r:-]+$", "")).otherwise("")


def stem(token: Column) -> Column:
    """The token without the first suffix that leaves more than three letters; ordinals in words."""
    out = token
    for suffix in reversed(SUFFIXES):
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        cut = F.concat(cut, F.lit("y")) if suffix == "ied" else cut
        out = F.when((F.length(token) > len(suffix) + 3) & token.endswith(suffix), cut).otherwise(out)
    for short, word in ORDINALS.items():
        out = F.when(token == short, word).otherwise(out)
    return out


def focus_terms(text: Column, stopwords: tuple[str, ...] | list[str] = STOPWORDS) -> Column:
    """Tokens of four letters or more with their simpler forms (ies, ing, ed, s), distinct, in order."""
    def forms(raw: Column) -> Column:
        cut = lambda ending, longer, n, add="": F.when(raw.endswith(ending) & (F.length(raw) > longer), F.concat(F.substring(raw, F.lit(1), F.length(raw) - n), F.lit(add)))
        return F.array(raw, cut("ies", 5, 3, "y"), cut("ing", 6, 3), cut("ed", 5, 2), cut("s", 4, 1))

    keep = lambda x: (F.length(x) >= 4) & ~x.isin(*stopwords)
    raw = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), keep)
    return F.array_distinct(F.filter(F.flatten(F.transform(raw, forms)), lambda x: x.isNotNull() & keep(x)))


def truncated(text: Column, most: int, mark: str = " ...") -> Column:
    """The text, or its first characters and a mark, ``most`` in all."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, most - len(mark))), F.lit(mark)))


def answer_text(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the words a, an and the; single blanks."""
    plain = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<![a-z0-9_])(a|an|the)(?![a-z0-9_])", " "), "[ \\t\\n\\r\\f]+", " "))


def relation_family(text: Column) -> Column:
    """The family of a relation's text; ``other:`` and its first three tokens if no rule fits."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "_-", "  "), r"\s+", " "))
    tokens = F.slice(words(F.regexp_replace(t, r"[^\p{L}\p{N}]", " ")), 1, 3)
    out = F.when(F.size(tokens) > 0, F.concat(F.lit("other:"), F.array_join(tokens, "_"))).otherwise("")
    for family, cues in reversed(RELATION_FAMILIES.items()):
        hit = reduce(lambda a, b: a | b, [t.contains(c) for c in cues])
        out = F.when(hit | t.isin(*LOCATION_WORDS) if family == "location" else hit, family).otherwise(out)
    return F.when(t == "", "").otherwise(out)


def phrase_slots(text: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """The slot values of the phrases that a text holds as whole words, in the order of the phrases, distinct."""
    padded = F.concat(F.lit(" "), graph_text(text), F.lit(" "))
    # the one-element transform makes the padded text once for all phrases
    hits = F.transform(F.array(padded), lambda x: F.array(*[F.when(x.contains(f" {p} "), value) for p, value in phrases]))[0]
    return F.array_distinct(F.filter(hits, lambda x: x.isNotNull()))


def capitalised_tokens(text: Column) -> Column:
    """Normalised tokens, three letters or more and no stopwords, that the text writes with a capital first."""
    raw = F.regexp_extract_all(text, F.lit("[A-Z][A-Za-z0-9]*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, F.lower), lambda x: (F.length(x) >= 3) & ~x.isin(*STOPWORDS))))


def role_query(question: Column, description: Column) -> Column:
    """What a role's channel is asked: the question and the evidence role, each on a line."""
    return F.concat(F.lit("Question: "), question, F.lit("\nEvidence role: "), description)


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(F.trim(t) != "", F.trim(t)) for t in texts], F.lit(""))


def parsed_answer(text: Column) -> Column:
    """What stands after the first ``Answer:``, trimmed; without one, the whole text."""
    at = F.instr(text, "Answer:")
    return F.when(at > 0, F.trim(F.substring(text, at + 7, F.length(text)))).otherwise(F.trim(text))


def hash_id(namespace: str, text: Column) -> Column:
    """An id: the namespace, a dash, and the md5 of the text."""
    return F.concat(F.lit(f"{namespace}-"), F.md5(text.cast("binary")))


def selected_ids(answer: Column, candidates: int, top: int) -> Column:
    """The candidate numbers in a selector's answer: from its first JSON object, in range, distinct, ``top`` at most."""
    found = F.from_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0), "selected_ids array<int>")["selected_ids"]
    inside = F.filter(found, lambda x: (x >= 0) & (x < candidates))
    return F.coalesce(F.slice(F.array_distinct(inside), 1, top), F.array().cast("array<int>"))


def freshness(last_seen: Column, step: Column, tau: float = 5.0) -> Column:
    """exp(-(step - last_seen) / tau); never over 1."""
    return F.exp(-F.greatest(step - last_seen, F.lit(0)) / tau)
