"""The stages against brute-force versions of what each must keep."""

import corpus_pipeline as cp
from helpers import lcs, near_components, read, words

from folioquery.llm import queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r[0]: r[1] for r in read(sf, "documents")}
    assert [n for n, _ in cp.STAGES] == ["language id", "line dedup", "near dedup", "decontamination", "packing"]

    lang = cp.identify_language(spark, docs, sf).cache()
    assert lang.columns == cp.COLUMNS and {r.doc_id for r in lang.collect()} == {i for i, t in text.items() if any(map(str.isalpha, t or ""))}

    lines = cp.drop_lines(spark, lang, sf).cache()
    left = {r.doc_id: r.text for r in lines.collect()}
    assert set(left) == {r.doc_id for r in lang.collect()} and all(r.n_chars == len(r.text) for r in lines.collect())
    where = {}
    for i in left:
        for key in {x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in text[i].split("\n")}:
            where.setdefault(key, set()).add(i)
    many = {k: max(v) for k, v in where.items() if len(k) >= 40 and len(v) >= 5}
    for i in left:
        kept = [x for x in text[i].split("\n") if (k := x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) not in many or many[k] == i]
        assert left[i] == "\n".join(kept)

    near = cp.drop_near_duplicates(spark, lines, sf).cache()
    want = {i for i, v in near_components(list(left.items()), 5, 80).items() if v[2]}
    assert {r.doc_id for r in near.collect()} == want and near.columns == cp.COLUMNS

    clean = cp.decontaminate(spark, near, sf).cache()
    items = [words(r[1], True) for r in read(sf, "benchmark")]
    gone = want - {r.doc_id for r in clean.collect()}
    joined = {i: " ".join(words(left[i], True)) for i in want}
    assert {i for i in want if any(" ".join(x) in joined[i] for x in items)} <= gone
    assert all(max(lcs(x, words(left[i], True)) / len(x) for x in items) >= 0.5 for i in gone)

    packed = cp.pack(spark, clean, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_run(spark, sf):
    rows = cp.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert cp.ORACLE_SQL is None and "op1_substring_dedup" in queries.queries()


def edges(spark, rows):
    """Documents with columns whose names the stages use themselves."""
    wide = [(i, t, c, "s", len(t) if t is not None else None, 1, "x", "y", [1], True) for i, t, c in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, n_words int, kept_text string, lang_pred string, leaks array<int>, kept boolean")


def test_stages_on_unusual_documents(spark, sf):
    """Nulls, empty and very long texts, repeated rows and clashing columns: what has letters stays, copies go but for one, rows of one id stay together."""
    english = "the house and the garden of the king were old and they had been there for a long time before the war " * 2
    other = "we walked along the river with our friends and then we went home because it was late and cold " * 2
    long = " ".join(f"word{k % 5000} and" for k in range(120_000))
    rows = [(1, english, "en"), (1, english, "en"), (2, None, "en"), (3, "", "en"), (4, "12 34 !?", None), (5, long, None), (6, other, "en"), (None, other + "by the sea", None), (7, english, None), (8, "a", None)]
    docs = edges(spark, rows)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)
    lang = cp.identify_language(spark, docs, sf)
    assert lang.columns == cp.COLUMNS and ids(lang) == sorted([1, 1, 5, 6, None, 7, 8], key=repr) and {r.lang for r in lang.collect()} == {"en"}
    lines = cp.drop_lines(spark, edges(spark, rows), sf)
    assert lines.columns == cp.COLUMNS and lines.count() == len(rows) and {r.doc_id: r.n_chars for r in lines.collect() if r.doc_id in (2, 3)} == {2: 0, 3: 0}
    near = cp.drop_near_duplicates(spark, docs, sf)
    assert near.columns == cp.COLUMNS and ids(near) == sorted([1, 1, 2, 3, 4, 5, 6, None, 8], key=repr)
    item = read(sf, "benchmark")[0][1]
    leaked = edges(spark, [*rows, (9, f"{other} {item} {english}", "en"), (10, f"{long} {item}", "en")])
    clean = cp.decontaminate(spark, leaked, sf)
    assert clean.columns == cp.COLUMNS and ids(clean) == ids(docs)
    packed = cp.pack(spark, docs.select(*cp.COLUMNS), sf).collect()
    assert sorted({repr(r.doc_id) for r in packed}) == sorted({repr(i) for i, _, _ in rows})
    assert sum(r.length for r in packed if r.doc_id == 2) == 1 and max(r.piece for r in packed if r.doc_id == 5) > 100


def test_stages_on_an_empty_table(spark, sf):
    docs = edges(spark, [])
    for name, stage in cp.STAGES:
        out = stage(spark, docs.select(*cp.COLUMNS) if name == "packing" else docs, sf)
        assert out.count() == 0 and (name == "packing" or out.columns == cp.COLUMNS)
