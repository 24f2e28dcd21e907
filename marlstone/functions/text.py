"""Text predicates and scalar functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.plans.rules import Pattern, Predicate

_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _like(c: Column, p: Pattern) -> Column:
    """Whether p matches; texts without the string that every match holds are told by a search for it, which costs far less, and a plain word
    is looked for from its first letter on, not from whatever may stand before it."""
    word = p.word()
    like = F.regexp_like(c, F.lit(p.java() if word is None else word))
    return like if p.literal() is None else F.contains(c, F.lit(p.literal())) & like


def predicate(p: Predicate, c: Column, there: Column | None = None) -> Column:
    """Whether the attribute c satisfies p. A missing attribute satisfies nothing, not even a negated match."""
    there = present(c) if there is None else there
    first = F.lit(p.pattern.java())
    if p.type == "match":
        held = _like(c, p.pattern)
        held = ~held if p.negate else held
    elif p.type == "freq":
        held = _COMPARE[p.op](F.regexp_count(c, first).cast("double"), F.lit(float(p.eta)))
    elif p.type == "cooccur":
        held = _like(c, p.pattern) & _like(c, p.other)
    else:
        a, b = F.regexp_instr(c, first), F.regexp_instr(c, F.lit(p.other.java()))
        held = (a > 0) & (b > 0) & (a < b)
    return F.coalesce(there & held, F.lit(False))


def sentences(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def normalized(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def digest(c: Column) -> Column:
    return F.sha2(normalized(c), 256)


def _let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.transform(F.array(value), then)[0]


def title_words(c: Column) -> Column:
    """The title's letter-only words in order, as struct(word, gap): gap is what stands between the word before and this one."""
    parts = F.split(F.regexp_replace(c, r"(\p{L}+)", "\u0001$1\u0002"), "\u0001")  # what stands before the first word, then word + U+0002 + what follows
    pairs = F.transform(parts, lambda x: F.split(x, "\u0002"))
    made = lambda q: F.transform(q, lambda x, i: F.struct(x[0].alias("word"), F.when(i > 1, F.get(F.get(q, i - 1), F.lit(1))).otherwise(F.lit("")).alias("gap")))
    return F.slice(_let(pairs, made), 2, 1 << 30)


def _starts(stop: tuple[str, ...]):
    return lambda x: (F.length(x["word"]) >= 2) & ~F.lower(x["word"]).isin(*(stop or ("",)))


def title_terms(c: Column, stop: tuple[str, ...] = (), most: int = 3) -> Column:
    """Lower-case word n-grams of 1 to `most` words with nothing but white space between them, that begin with a word of two letters or more outside `stop`."""
    starts = _starts(stop)

    def of(w: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.slice(w, i, n))
        close = lambda g: F.forall(F.slice(g, 2, n), lambda x: F.regexp_like(x["gap"], F.lit(r"^\s+$")))
        return F.filter(runs, lambda g: (F.size(g) == n) & starts(F.get(g, F.lit(0))) & close(g))

    return _let(title_words(c), lambda w: F.transform(F.concat(*[of(w, n) for n in range(1, most + 1)]), lambda g: F.array_join(F.transform(g, lambda x: F.lower(x["word"])), " ")))


def title_pairs(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """struct(family, a, b) of neighbouring single terms: Cooccur in alphabetical order, Before in the title's; equal words make none."""
    pair = lambda family, a, b: F.struct(F.lit(family).alias("family"), a.alias("a"), b.alias("b"))

    def made(w: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.slice(w, i, 2))
        both = lambda g: F.array(pair("Cooccur", F.least(g[0], g[1]), F.greatest(g[0], g[1])), pair("Before", g[0], g[1]))
        return F.array_distinct(F.flatten(F.transform(F.filter(two, lambda g: (F.size(g) == 2) & (F.get(g, F.lit(0)) != F.get(g, F.lit(1)))), both)))

    return _let(F.transform(F.filter(title_words(c), _starts(stop)), lambda x: F.lower(x["word"])), made)


_W = "[A-Za-z0-9_]"
#: A word boundary of ASCII words, whatever the regex engine's own is.
BOUND = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def number_spans(c: Column) -> Column:
    """Numbers with inner separators and a unit of up to three letters or a percent sign that a word follows, as whole words."""
    return F.regexp_extract_all(c, F.lit(BOUND + r"[0-9]+(?:[.,:/-][0-9]+)*(?:%|[A-Za-z]{1,3})?" + BOUND), 0)


def literal_count(c: Column, words: tuple[str, ...]) -> Column:
    """How many of the text's ASCII words are one of `words`, case kept."""
    return F.size(F.filter(F.regexp_extract_all(c, F.lit(f"{_W}+"), 0), lambda x: x.isin(*words))).cast("long")


def term_offsets(c: Column) -> Column:
    """struct(term, start, end) of lower-case ASCII tokens of two letters or more, and of neighbouring two; offsets in characters of the text."""
    parts = F.split(F.regexp_replace(c, "([A-Za-z]{2,})", "\u0001$1\u0001"), "\u0001")  # odd places hold the tokens
    kind = "array<struct<term:string,start:int,end:int>>"
    one = lambda a, x: F.array(F.struct(F.lower(x).alias("term"), a["n"].alias("start"), (a["n"] + F.length(x)).alias("end")))
    step = lambda a, x: F.struct((a["n"] + F.length(x)).alias("n"), F.when(a["i"] % 2 == 1, F.concat(a["out"], one(a, x))).otherwise(a["out"]).alias("out"), (a["i"] + 1).alias("i"))
    at = F.aggregate(parts, F.struct(F.lit(0).alias("n"), F.array().cast(kind).alias("out"), F.lit(0).alias("i")), step, lambda a: a["out"])

    def made(t: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: F.slice(t, i, 2))
        joined = F.transform(F.filter(two, lambda g: F.size(g) == 2), lambda g: F.struct(F.concat_ws(" ", g[0]["term"], g[1]["term"]).alias("term"), g[0]["start"].alias("start"), g[1]["end"].alias("end")))
        return F.concat(t, joined)

    return _let(at, made)


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - clip)), F.lit(clip))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def xml_field(c: Column, tag: str) -> Column:
    """First content of the tag, with the five named entities resolved."""
    found = F.regexp_extract(c, f"(?s)<{tag}>(.*?)</{tag}>", 1)
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], found)
