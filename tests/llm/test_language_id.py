import zlib

from helpers import docs, empty, read
from pyspark.sql import functions as F

from folioquery.llm import language_id as op
from folioquery.llm import queries


def test_query_on_held_out_documents(spark, sf):
    lang = {r[0]: r[2] for r in read(sf, "documents")}
    got = queries.op10_language_id(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark, sf):
    model = op.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "éè"), (None, "the of and is"), (6, "的"), (7, "x " * 100_000)]
    out = op.predict(docs(spark, rows), model)
    assert out.columns[-2:] == ["lang_pred", "score"] and out.columns.count("score") == 2
    got = {r[0]: r[-2:] for r in map(tuple, out.collect())}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3)) and all(got[i][0] in model.languages for i in (4, None, 6, 7))
    assert op.predict(empty(spark), model).collect() == []


def test_few_languages(spark):
    rows = docs(spark, [(i, "one two three") for i in range(9)])
    none = op.train(rows.where("false"))
    assert {r.lang_pred for r in op.predict(rows.select("doc_id", "text"), none).collect()} == {"und"}
    one = op.train(rows)
    assert {(r.lang_pred, r.score) for r in op.predict(rows.select("doc_id", "text"), one).collect()} == {("en", 1.0)}
    null = rows.withColumn("lang", F.lit(None).cast("string"))
    assert op.train(null).languages == []


def test_families():
    assert op.family("en-US") == op.family("de") == "germanic" and op.family("pt_BR") == "romance" and op.family("xx") == "xx"


def test_prediction_does_not_depend_on_slices(spark, sf):
    import numpy as np
    import pyarrow as pa

    from folioquery.llm import kit

    model = op.train(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = pa.array([r[1] for r in read(sf, "documents")][:40])
    whole = model.margins(*kit.text_arrays(texts))
    parts = np.concatenate([model.margins(d, b) for _, _, d, b in kit.slices(texts, 100)])
    assert np.abs(whole - parts).max() < 1e-5


def test_fitting_takes_500_documents_a_language_without_copies_of_the_matrix(spark, monkeypatch):
    import numpy as np

    sizes, fit = [], op.fit_svm

    def watched(yes, no):
        sizes.extend((len(yes), len(no)))
        assert yes.base is not None and yes.base is no.base
        return fit(yes, no)

    monkeypatch.setattr(op, "fit_svm", watched)
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") + str(i)) for i in range(1000)]
    df = docs(spark, rows).withColumn("lang", F.expr("if(doc_id % 2 = 1, 'en', 'de')"))
    model = op.train(df, dims=256)
    assert sizes == [500, 500] and np.isfinite(model.table).all()
    assert all(r.lang_pred == r.lang for r in op.predict(df.select("doc_id", "text", "lang"), model).collect())


def test_many_languages_in_bounded_memory(spark, monkeypatch):
    """Sixty codes of families of their own are 1,770 machines: gathers of every byte's row would be 170 MB a slice."""
    import random

    import numpy as np
    import pyarrow as pa

    from folioquery.llm import kit

    rng = random.Random(6)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(60)]
    text = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=5)) for _ in range(n))
    rows = [(60 * j + k, text(k, 40)) for j in range(6) for k in range(60)]
    df = docs(spark, rows).withColumn("lang", F.concat(F.lit("x"), (F.col("doc_id") % 60).cast("string")))
    opened, fit = [], op.fit_svm
    monkeypatch.setattr(op, "fit_svm", lambda yes, no: (opened.append(len(yes) + len(no)), fit(yes, no, 15))[1])
    model = op.train(df, dims=512)
    assert len(model.machines) == 1770 and set(opened) == {12}
    texts = [text(k, 200) for k in range(20)] + ["", text(3, 9000)]
    data, bounds = kit.text_arrays(pa.array(texts))
    blocks = model.margins(data, bounds)
    monkeypatch.setattr(op, "_GATHER", 1 << 40)
    assert np.abs(blocks - model.margins(data, bounds)).max() < 1e-4
    codes, _ = model.predict(data, bounds)
    assert sum(c == f"x{k}" for k, c in enumerate(codes[:20])) >= 18 and codes[20] == "und"


def votes(model, margins, level, names):
    """The contract again, one document at a time: most duels won, then the margins, then the first name."""
    best = []
    for row in margins:
        wins, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for m, g in zip(model.machines, row, strict=True):
            if m.level == level:
                wins[m.yes if g > 0 else m.no] += 1
                sums[m.yes] += g
                sums[m.no] -= g
        best.append(max(names, key=lambda c: (wins[c], sums[c], [-ord(x) for x in c])))
    return best


def test_votes_against_brute_force(spark, sf):
    import numpy as np

    model = op.train(spark.read.parquet(f"{sf}/documents.parquet"))
    table, texts = np.array(model.table[:-1]), [r[1] for r in read(sf, "documents") if r[1]][:60]
    margins = []
    for t in texts:
        raw = bytes(op._TABLE[list(t.encode())])
        counts = np.zeros(model.dims)
        for n in (2, 3, 4):
            for k in range(len(raw) - n + 1):
                v = int.from_bytes(raw[k : k + n], "big")
                h = ((v ^ v >> 15) * 0x9E3779B1 + (n * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF
                h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
                counts[(h >> 8) % model.dims] += 1
        margins.append(counts / max(1, counts.sum()) @ table + [m.bias for m in model.machines])
    groups = {}
    for code in model.languages:
        groups.setdefault(op.family(code), []).append(code)
    kin = votes(model, margins, "", sorted(groups))
    want = [groups[f][0] if len(groups[f]) == 1 else votes(model, [m], f, groups[f])[0] for f, m in zip(kin, margins, strict=True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in op.predict(df, model).collect()}
    assert sum(got[i] == want[i] or got[i] == "und" for i in got) >= len(texts) - 1


def test_sample_is_exact_whatever_the_ids_are(spark):
    texts = {"en": "the house and the garden of the king", "es": "la casa y el jardin del rey que"}
    rows = [(7, f"{texts[c]} {k}", c) for k in range(3000) for c in texts]
    one_id = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    no_id = one_id.withColumn("doc_id", F.lit(None).cast("long"))
    same = spark.createDataFrame([(7, texts[c], c) for _ in range(2000) for c in texts], "doc_id long, text string, lang string")
    for df, most in ((one_id, 50), (no_id, 50), (same, 1)):
        counts = {r[0]: r[1] for r in df.groupBy("lang").count().collect()}
        hashed = df.select("lang", F.xxhash64("doc_id", "text", F.lit(17)).alias("h"))
        last = op._last_hashes(hashed, counts, 50)
        got = hashed.where(F.col("h") <= op._by_language(last)).distinct().groupBy("lang").count().collect()
        assert {r[0]: r[1] for r in got} == dict.fromkeys(texts, most)
        model = op.train(df, per_language=50)
        assert sorted(model.languages) == ["en", "es"]
        if most > 1:
            assert {r.lang_pred for r in op.predict(df.where("lang = 'es'").limit(5), model).collect()} == {"es"}
