import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.llm import languages

SENTENCES = {
    "en": "The pump stops as soon as the pressure is larger than the limit, so we had to repeat the whole run.",
    "de": "Die Pumpe bleibt stehen, sobald der Druck zu hoch wird, deshalb mussten wir die ganze Messung wiederholen.",
    "fr": "La pompe s'arrête dès que la pression est trop haute, donc nous avons dû refaire toute la mesure.",
    "ja": "圧力が高くなるとすぐにポンプが止まるので、もう一度測定をやり直しました。",
    "ru": "Насос останавливается, как только давление становится слишком большим, и пришлось повторить измерение.",
}


def test_labels(spark):
    want = {"en-US": "en", "EN": "en", "eng": "en", "Deutsch": "de", "zh-CN": "zh", "pt_BR": "pt", "": None, " ": None, "und": None, "mul": None, "unknown": None, "??": None}
    df = spark.createDataFrame([(k,) for k in want], "l string").select("l", languages.label_of(F.col("l")).alias("x"))
    assert {r["l"]: r["x"] for r in df.collect()} == want
    assert spark.range(1).select(languages.label_of(F.lit(None).cast("string")).alias("x")).first()["x"] is None


def test_code_links_and_names_are_no_prose():
    code = [
        "```sql\nSELECT a, b FROM t\nWHERE x > 2 GROUP BY a;\n```", "    def fix(a, b=1):\n        rows = [x for x in a if x > b]\n        return sum(rows) / max(len(rows), 33)", "run <- read.table('a.tsv', sep='x')\nprint(dim(run))",
        "Traceback:\n  File \"a.py\", line 3, in x\nValueError: a has length 63, expected 64", "$ convert --blank tol.mzML --tol 1.2 > trace.txt\nerror: blank index 64 out of range", "<pre><code>a &lt;- b\nc</code></pre>", "https://a.example/b/c?d=1", '{"a": 1, "b": [1, 2], "c": null}',
        "for (int i = 0; i < 92; i++) {\n    rt[i] -= run[i] * 0.037;\n}", "# nur zum Testen",
    ]
    for c in code:
        assert sum(languages.units_of(s)[0] for s in languages.segments(c)) < languages.LEAST_WORDS, (c, languages.segments(c))
    for s in SENTENCES.values():
        assert languages.segments(s + "\n\n" + code[0]) == [s]
    assert languages.segments(None) == languages.segments("") == languages.segments("  \n") == []
    upper = "WITH THE NEW PUMP WE HAD TO REPEAT THE RUN, BUT ONLY ONCE."
    assert languages.segments("```\nx = 1\n```\r\n\r\n" + upper) == [upper]


def texts(small_dir, n):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small_dir}/documents.parquet", columns=["lang", "text"]).to_pandas()
    return t


@pytest.fixture(scope="module")
def model():
    import os

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    t = texts(d, 0)
    rows = [(x, y) for x, y in zip(t["lang"], t["text"]) if x in languages.NAMES and y and len(y) > 60]
    return languages.fit(rows[::2]), rows[1::2]


def test_held_out_accuracy(model):
    fitted, held = model
    good = total = 0
    for lang, text in held:
        seg = [s for s in languages.segments(text) if sum(languages.units_of(s)) >= 8]
        if seg:
            got, _ = fitted.classify(seg)
            good += max(set(got), key=got.count) == lang
            total += 1
    # labels themselves are wrong for some of the documents
    assert total > 200 and good / total > 0.9


def test_unseen_sentences(model):
    fitted, _ = model
    got, sure = fitted.classify(list(SENTENCES.values()))
    assert got == list(SENTENCES) and (sure > 0.5).all()
    assert fitted.classify([])[0] == []


def test_documents(spark, model):
    fitted, _ = model
    en, de, ja = SENTENCES["en"], SENTENCES["de"], SENTENCES["ja"]
    rows = [(1, en, "en-GB"), (2, en, "de"), (3, f"{en} {de}", "en"), (4, f"{en}\n\n{ja}", None), (5, None, "en"), (6, "", "en"), (7, "+1 Danke", "en"), (8, (en + " ") * 3000, "und"), (9, de, " DE "), (2, en, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    got = {(r["doc_id"], r["lang"]) for r in languages.found(languages.label_segments(df, fitted)).collect()}
    assert got == {(2, "en"), (3, "en"), (3, "de"), (4, "en"), (4, "ja"), (8, "en")}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "nothing is known here", None)], "doc_id long, text string, lang string")
    assert languages.found(languages.label_segments(df)).count() == 0
    assert languages.label_segments(df.limit(0)).count() == 0
    assert languages.presence([]).shape == (0, languages.DIMENSIONS) and np.isfinite(languages.presence([""])).all()
