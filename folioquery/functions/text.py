"""Text functions: analyzer, keyword queries, BM25, phrase search, and display formats. All are built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BM25 constants, and the floor of the inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _folding() -> tuple[str, str]:
    """Accented letters of the Latin blocks and their base letters, from canonical decompositions."""
    source, target = "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(code).lower()
        base = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(base) > 1 and len(base.strip()) and not unicodedata.combining(base[0]) and c not in source:
            source, target = source + c, target + base[0]
    return source, target


_FROM, _TO = _folding()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def fold(c: Column) -> Column:
    """Lower case without diacritics: precomposed Latin letters map to their base, combining marks go."""
    return F.translate(F.lower(c), _FROM + _MARKS, _TO)


def fold_text(s: str) -> str:
    return s.lower().translate(str.maketrans(_FROM, _TO, _MARKS))


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text; null for null."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Words and punctuation marks: the offline token counter."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


@dataclass(frozen=True)
class Term:
    """A phrase of one or more tokens; the last may stand for a prefix."""

    words: tuple[str, ...]
    prefix: bool = False


def analyze(s: str) -> tuple[str, ...]:
    return tuple(re.findall(r"[^\W_]+", fold_text(s)))


def parse_keywords(query: str) -> list[Term]:
    """Split at white space; a token with a hyphen is a phrase; others split at letter-digit borders, lower-cased; three or
    more characters match as a prefix. Terms are alternatives. Punctuation that no token can hold is dropped."""
    out: list[Term] = []
    for token in query.split():
        if "-" in token:
            words = analyze(token.strip("\"'"))
            if words:
                out.append(Term(words))
            continue
        for piece in re.findall(r"\d+|\D+", token):
            bare = piece.strip().strip("\"'").lower()
            if not bare:
                continue
            words = analyze(bare)
            if words:
                out.append(Term(words, len(bare) >= 3 and len(words) == 1 and '"' not in bare and "*" not in bare or bare.endswith("*")))
    return list(dict.fromkeys(out))


def occurrences(toks: Column, term: Term) -> Column:
    """How often a term occurs in a token array."""
    words = [F.lit(w) for w in term.words]
    if len(words) == 1:
        return F.size(F.filter(toks, lambda t: t.startswith(words[0]) if term.prefix else t == words[0]))
    n = len(words)

    def runs(k: Column) -> Column:  # the tokens bound once; n shifted copies side by side
        last = F.greatest(F.size(k) - n + 1, F.lit(0))
        zipped = F.arrays_zip(*[F.slice(k, F.lit(i + 1), last).alias(f"w{i}") for i in range(n)])
        return F.size(F.filter(zipped, lambda z: reduce(lambda a, b: a & b, (z[f"w{i}"] == w for i, w in enumerate(words)))))

    return F.element_at(F.transform(F.array(toks), runs), 1)


def bm25(docs: DataFrame, key: str, text: str | dict[str, float], terms: list[Term]) -> DataFrame:
    """(key, rank) of matching rows; rank is negative and lower is better.

    Statistics cover all rows of ``docs``, also those a caller filters away later: one pass for counts (a single
    row, so its broadcast has a fixed size), one for scores. Several columns may be given with weights: occurrences then
    count by their column's weight, lengths add up, and a term is in a row if it is in any column.
    """
    weights = {text: 1.0} if isinstance(text, str) else text
    names = [f"__k{j}" for j in range(len(weights))]
    counted = docs.select(F.col(key), *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in zip(weights, names, strict=True)])
    found = lambda t: reduce(lambda a, b: a + b, (F.lit(float(w)) * occurrences(F.col(n), t) for n, w in zip(names, weights.values(), strict=True)))
    counted = counted.select(key, reduce(lambda a, b: a + b, (F.size(n) for n in names)).alias("__dl"), *[found(t).alias(f"__tf{i}") for i, t in enumerate(terms)])
    if not terms:
        return counted.where(F.lit(False)).select(key, F.lit(0.0).alias("rank"))
    facts = counted.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))])
    hit = reduce(lambda a, b: a | b, (F.col(f"__tf{i}") > 0 for i in range(len(terms))))
    scored = counted.where(hit).join(F.broadcast(facts))  # one row
    return scored.select(key, (-bm25_score([F.col(f"__tf{i}") for i in range(len(terms))], F.col("__dl"))).alias("rank"))


def bm25_score(tfs: list[Column], length: Column) -> Column:
    """The score from term counts, beside columns ``__n`` (documents), ``__avg`` (mean length) and ``__df<i>`` (documents with the i-th term)."""
    norm = K1 * (1 - B + B * length / F.col("__avg"))
    score = F.lit(0.0)
    for i, tf in enumerate(tfs):
        df = F.col(f"__df{i}")
        idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
        score = score + idf * (tf * (K1 + 1)) / (tf + norm)
    return score


# ---------------------------------------------------------------- display formats


def _scaled(v: Column, steps: list[tuple[float, str]], digits: int) -> Column:
    shown = lambda x: F.translate(F.format_number(x, digits), ",", "")  # noqa: E731  rounds the binary value, ties to even
    out = None
    for size, mark in steps:
        text = F.concat(F.lit("$"), shown(v / size), F.lit(mark))
        out = F.when(F.abs(v) >= size, text) if out is None else out.when(F.abs(v) >= size, text)
    return out.otherwise(F.concat(F.lit("$"), shown(v)))


def format_value(v: Column) -> Column:
    """Billions, millions, thousands with three decimals; null and zero as a dash."""
    v = v.cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v == 0), "-").otherwise(_scaled(v, [(1e9, "B"), (1e6, "M"), (1e3, "K")], 3))


def format_market_cap(v: Column) -> Column:
    """Trillions, billions, millions with one decimal; null and zero as N/A."""
    v = v.cast("double")
    return F.when(v.isNull() | (v == 0), "N/A").otherwise(_scaled(v, [(1e12, "T"), (1e9, "B"), (1e6, "M")], 1))


def format_year_end(c: Column) -> Column:
    """MMDD to a month's name and day; other text as it is."""
    day = F.try_to_date(F.concat(F.lit("2000"), c), "yyyyMMdd")
    return F.when(c.rlike(r"^\d{4}$") & day.isNotNull(), F.date_format(day, "MMMM d")).otherwise(c)


def expand_forms(forms: list[str]) -> list[str]:
    """Each base form with its amendment."""
    return [x for f in forms for x in ((f,) if f.endswith("/A") else (f, f"{f}/A"))]
