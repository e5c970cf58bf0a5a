"""Small corpora and brute-force versions."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(_UP) if lower else text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs(spark, rows):
    """Rows (doc_id, text), with columns that clash with names inside the operators."""
    wide = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0, None) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string, score double, kept_text string")


def empty(spark):
    return docs(spark, [])


def read(sf, name):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").fetchall()


def substring_dedup(rows, width=20):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        dead = bytearray(len(w))
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                dead[k : k + width] = b"\1" * width
            seen.add(key)
        out[i] = (len(w), sum(dead), " ".join(a for a, b in zip(w, dead, strict=True) if not b))
    return out


def shingles(text, k):
    w = words(text, True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(rows, k, share):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def quality(text):
    text = text or ""
    w = words(text)
    triples = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count, covered = Counter(triples), set()
    for k, t in enumerate(triples):
        if count[t] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(covered)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n, len(w) < 50 or 100 * n > 50 * len(w)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
        row = now
    return row[-1]
