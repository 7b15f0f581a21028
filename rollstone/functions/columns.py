"""Scalar functions over columns. All but sha3_512 and html_text are built-in expressions that stay in the JVM."""

from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: parts of a concept's name that make it invalid, as they stand, and in any case
INVALID = ("missing", "_births", "_deaths", "http://dbpedia.org/class/yago/", "Category:WikiProjects", "Category:Wikipedia", "_stubs", "_templates", "cleanup", "unknown", "pages")
INVALID_ANY_CASE = ("articles", "unprintworthy_redirects")
# fixed values: what stands for the beginning of a resource's address; the first that fits counts
PREFIXES = (
    ("http://dbpedia.org/ontology/", "dbo"),
    ("http://dbpedia.org/class/yago/", "yago"),
    ("http://dbpedia.org/resource/", "DBpedia"),
    ("http://www.w3.org/2000/01/rdf-schema#", "rdfs"),
    ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdf"),
    ("http://dbpedia.org/property/", "dbp"),
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays of numbers, in double; null for a zero vector or different lengths."""
    wide = [_c(x).cast("array<double>") for x in (a, b)]
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(*wide), F.sqrt(dot(wide[0], wide[0])) * F.sqrt(dot(wide[1], wide[1])))


def is_valid_concept(c: Column | str) -> Column:
    """Whether a concept's name has none of the parts that mark upkeep concepts; null for null."""
    c = _c(c)
    out = F.lit(True)
    for part in INVALID:
        out = out & ~F.contains(c, F.lit(part))
    for part in INVALID_ANY_CASE:
        out = out & ~F.contains(F.lower(c), F.lit(part))
    return F.when(c.isNotNull(), out)


def shorten_url(c: Column | str) -> Column:
    """prefix:rest by the known beginnings, else other: and what follows the last slash."""
    c = _c(c)
    out = None
    for start, short in PREFIXES:
        rest = F.concat(F.lit(f"{short}:"), F.substring(c, len(start) + 1, 1 << 30))
        out = F.when(F.startswith(c, F.lit(start)), rest) if out is None else out.when(F.startswith(c, F.lit(start)), rest)
    return out.when(c.isNotNull(), F.concat(F.lit("other:"), F.substring_index(c, "/", -1)))


def local_id(c: Column | str, prefix: str) -> Column:
    """What follows the last occurrence of prefix, blanks as underscores."""
    return F.replace(F.element_at(F.split(_c(c), F.lit("\\Q" + prefix + "\\E")), -1), F.lit(" "), F.lit("_"))


def display_name(c: Column | str) -> Column:
    """The part after the last colon with blanks for underscores."""
    return F.replace(F.substring_index(_c(c), ":", -1), F.lit("_"), F.lit(" "))


def set_key(c: Column | str, separator: str = ",") -> Column:
    """One key for a list whatever its order: sorted and joined."""
    return F.array_join(F.array_sort(_c(c)), separator)


def split_terms(c: Column | str) -> Column:
    """A list of terms divided by pipes or commas, trimmed, empty ones dropped; struct of concepts (Category:...) and entities, both sorted."""
    terms = F.filter(F.transform(F.split(_c(c), "[|,]"), lambda x: F.trim(x)), lambda x: x != "")
    is_concept = lambda x: F.startswith(x, F.lit("Category:"))
    return F.struct(F.array_sort(F.filter(terms, is_concept)).alias("concepts"), F.array_sort(F.filter(terms, lambda x: ~is_concept(x))).alias("entities"))


def pattern_score(terms: Column | str, documents: Column | str) -> Column:
    """log2(terms + 0.1) * log10(documents + 0.1)."""
    return F.log2(_c(terms) + 0.1) * F.log10(_c(documents) + 0.1)


def specificity(members: Column | str, whole: Column | str) -> Column:
    """-log10(members / whole), three digits; 0 without members."""
    n = _c(members)
    return F.when(n == 0, 0.0).otherwise(F.round(-F.log10(n / _c(whole)), 3))


def drift(siblings: Column | str, base: float = 0.95) -> Column:
    return F.pow(F.lit(base), _c(siblings))


def squash(c: Column | str) -> Column:
    """x / (1 + x), written as 1 - 1 / (1 + x)."""
    return 1 - 1 / (1 + _c(c))


def change_percent(begin: Column | str, end: Column | str) -> Column:
    """Change in percent; 0 where the beginning isn't positive."""
    begin, end = _c(begin), _c(end)
    return F.when(begin > 0, (end - begin) / begin * 100).otherwise(0.0)


def sentence_case(c: Column | str) -> Column:
    """The first word as it is, the rest in lower case."""
    c = _c(c)
    at = F.instr(c, " ")
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at), F.lower(F.substr(c, at + 1)))).otherwise(c)


def cut_at(c: Column | str, phrases: list[str]) -> Column:
    """The text up to the first of the phrases, in any case; a phrase at the very start doesn't cut."""
    c = _c(c)
    places = [F.when(F.instr(F.lower(c), p.lower()) > 1, F.instr(F.lower(c), p.lower())) for p in phrases]
    first = F.least(*places, F.lit(1 << 30)) if places else F.lit(1 << 30)
    return F.substr(c, F.lit(1), first - 1)


def amount_in_millions(c: Column | str) -> Column:
    """$12.3M and $1.2B as millions; null for anything else."""
    c = _c(c)
    n = F.regexp_extract(c, "^\\$([0-9]+(?:\\.[0-9]+)?)([MB])$", 1)
    unit = F.regexp_extract(c, "^\\$([0-9]+(?:\\.[0-9]+)?)([MB])$", 2)
    return F.when(unit == "M", n.cast("double")).when(unit == "B", n.cast("double") * 1000)


def no_punctuation(c: Column | str) -> Column:
    """ASCII punctuation as blanks."""
    return F.regexp_replace(_c(c), "[!-/:-@\\[-`{-~]", " ")


def signed_sentiment(label: Column | str, score: Column | str) -> Column:
    """The score, negative for the label NEG, 0 for NEU."""
    label, score = _c(label), _c(score)
    return F.when(label == "NEG", -score).when(label == "NEU", 0.0).otherwise(score)


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Whether one of the words occurs, in any case, taken literally; null for null."""
    c = F.lower(_c(c))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w.lower()))
    return F.when(c.isNotNull(), out)


def subsets(c: Column | str) -> Column:
    """All subsets of a list's members, the empty one included, by ascending bit pattern; there are 2 to the power of its length, and Spark refuses more than an array can hold."""
    c = _c(c)
    masks = F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.size(c)) - 1)
    return F.when(c.isNotNull(), F.transform(masks, lambda m: F.filter(c, lambda _, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1)))


def format_time(c: Column | str, date_only: bool = False) -> Column:
    """yyyy-MM-dd HH:mm:ss, or the date alone; the first of January of the year 1 stands for no time and becomes null."""
    c = _c(c)
    return F.when(F.year(c) > 1, F.date_format(c, "yyyy-MM-dd" if date_only else "yyyy-MM-dd HH:mm:ss"))


def minutes_between(begin: Column | str, end: Column | str) -> Column:
    """Whole minutes from begin to end."""
    return F.floor((F.unix_seconds(_c(end).cast("timestamp")) - F.unix_seconds(_c(begin).cast("timestamp"))) / 60)


def is_fresh(last: Column | str, now: Column, minutes: int = 15) -> Column:
    """Whether a heartbeat is at most so many minutes old; false for none."""
    return F.coalesce(minutes_between(last, now) <= minutes, F.lit(False))


def json_text(c: Column | str) -> Column:
    """A struct, map or array as JSON; null fields are left out."""
    return F.to_json(_c(c))


def session_id() -> Column:
    """A new random id for each row."""
    return F.uuid()


@F.pandas_udf(StringType())
def sha3_512(s: pd.Series) -> pd.Series:
    """Hexadecimal SHA3-512, which the JVM functions lack; null for null."""
    return s.map(lambda x: None if x is None else hashlib.sha3_512(x.encode()).hexdigest())


class _Text(HTMLParser):
    def __init__(self, ids: tuple[str, ...]):
        super().__init__()
        self.ids, self.depth, self.inside, self.found = ids, 0, {}, {}

    #: Elements that have no end tag.
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        self.depth += 1
        i = dict(attrs).get("id")
        if i in self.ids and i not in self.found:
            self.inside[i], self.found[i] = self.depth, []

    def handle_endtag(self, tag):
        if tag in self.VOID:
            return
        for i in [i for i, d in self.inside.items() if d >= self.depth]:
            del self.inside[i]
        self.depth -= 1

    def handle_data(self, data):
        for i in self.inside:
            self.found[i].append(data)


def html_text(c: Column | str, *ids: str) -> Column:
    """Text of the first of the elements with these ids that a page has, its lines trimmed and empty ones dropped; null if none."""

    @F.pandas_udf(StringType())
    def text(s: pd.Series) -> pd.Series:
        def one(page):
            if page is None:
                return None
            p = _Text(ids)
            p.feed(page)
            got = next((p.found[i] for i in ids if i in p.found), None)
            return None if got is None else "\n".join(x.strip() for x in "".join(got).splitlines() if x.strip())

        return s.map(one)

    return text(_c(c))
