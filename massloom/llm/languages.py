"""Language of documents and of the segments of mixed ones, by string kernels.

A segment is the set of its character n-grams of several lengths (a blended-spectrum
presence kernel, normalised by the sets' sizes). Landmark segments give a Nyström map,
on which one kernel ridge regression for each language is fitted against the rest.
Segments are scored in batches as matrix products. The model is fitted on a bounded
sample of labelled rows; everything else runs over all rows and whole texts.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed values: the languages and the writings of their names
NAMES = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pl": ["pl", "pol", "polish", "polski"],
    "ru": ["ru", "rus", "russian", "русский"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "中文"],
}
LANGUAGES = list(NAMES)
#: a language counts from so many running words, or characters in scripts without spaces
LEAST_WORDS = 8
LEAST_CHARS = 15
NO_SPACES = {"ja", "zh"}
#: size of the fit: labelled documents, segments and landmarks for each language
SAMPLE_DOCS = 250
SAMPLE_SEGMENTS = 500
LANDMARKS = 32
#: n-gram lengths, hash dimensions and ridge
GRAMS = (1, 2, 3, 4)
DIMENSIONS = 8192
RIDGE = 1e-3
BATCH = 64


def label_of(c: Column) -> Column:
    """Language that a label names in any writing (region, longer code, name, upper case); else NULL."""
    word = F.lower(F.trim(c))
    head = F.regexp_extract(word, r"^([^\s_\-(]+)", 1)
    pairs = [F.lit(x) for lang, names in NAMES.items() for n in names for x in (n, lang)]
    known = F.create_map(*pairs)
    return F.coalesce(F.element_at(known, word), F.element_at(known, head))


# ---------------------------------------------------------------- prose and segments

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\S\n]*$|\Z)", re.S | re.M)
_HTML_CODE = re.compile(r"<(pre|code|kbd|samp|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_INLINE = re.compile(r"`[^`\n]*`")
_MARKUP_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\n]*\)")
_LINK = re.compile(r"<?(?:https?|ftp)://\S+|<?www\.\S+", re.I)
_FILE = re.compile(r"(?:[\w.\-]*[/\\])*[\w\-]+\.(?:mzml|mzxml|raw|csv|tsv|txt|py|r|sql|json|xml|xlsx?|zip|d|cfg|ini|log|pdf|png|jpe?g)\b", re.I)
_TAG = re.compile(r"<[^<>\n]{0,200}>|<\|\w+\|>")
_PAREN_NUMBERS = re.compile(r"[(\[][^()\[\]\n]{0,40}\d[^()\[\]\n]{0,20}[)\]]")
_CODE_LINE = re.compile(
    r"""^\s*(?:\#|//|/\*|\*/|--\s|\$\s|>>>|\.\.\.\s|@\w+|%)          # comments and prompts
    |^\s*(?:def|class|for|while|if|elif|else|try|except|with|return|import|from|print|int|void|double|float|const|let|var|function|public|static|library|require)\b.*[(){}:;=]
    |^\s*(?:import|from)\s+\w[\w.]*(?:\s+(?:import|as)\b.*)?$
    |^\s*(?:return|break|continue|pass)\b[^.]*$
    |^\s*(?:SELECT|FROM|WHERE|GROUP\ BY|ORDER\ BY|INSERT\ INTO|UPDATE|JOIN|LEFT\ JOIN|INNER\ JOIN|HAVING|LIMIT|WITH|CREATE\ TABLE)\s[^.!?]*(?:[_(<>=*;,]|\w+_\w+|\d|$)
    |^\s*(?:Traceback|[A-Z]\w*(?:Error|Exception|Warning)\b|error:|warning:|File\s")
    |^\s*[\w.\[\]"'$]+\s*(?:=|<-|\+=|-=|:=|\+\+)\s*\S
    |^\s*[\w.]+\([^)]*\)\s*;?\s*$
    |^\s*[{}\[\]();,]+\s*$
    |[;{}]\s*$
    |^\s*["']?\w+["']?\s*:\s*[\[{"'\d]
    |^\s*[{\[].*[}\]],?\s*$""",
    re.X,
)
_PLAINLY_CODE = re.compile(r"^\s*(?:[\w.\[\]\"'$]+\s*(?:=|<-|\+=|-=|:=)\s*\S|\#(?!\d)|//|/\*|\*/|--\s|\$\s|>>>|%)")
#: so many plain words in a row are a sentence, whatever its first word and its brackets look like
_SENTENCE = re.compile(r"(?:[^\W\d_]+[,'’]? ){5,}[^\W\d_]+|[぀-ヿ㐀-鿿、ー々]{8,}")
_END = re.compile(r"(?<=[.!?…])[\s\"'»)\]]+|(?<=[。！？])|\n+|\t+")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: what a text must hold for the costly patterns to have a chance
_MAY_BE_FILE = re.compile(r"\.(?:mzml|mzxml|raw|csv|tsv|txt|py|r|sql|json|xml|xlsx?|zip|d|cfg|ini|log|pdf|png|jpe?g)\b", re.I)
_MAY_TURN = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u3002\u3001\uff01\uff1f\u0400-\u04ff]")
_KANA, _HAN, _CYRILLIC = re.compile(r"[぀-ヿｦ-ﾟ]"), re.compile(r"[㐀-鿿]"), re.compile(r"[Ѐ-ӿ]")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿ｦ-ﾟ々〆ー]")
_TURN = re.compile(r"(?<=[぀-ヿ㐀-鿿。、！？])\s*(?=[A-Za-zÀ-ÿЀ-ӿ])|(?<=[A-Za-zÀ-ÿЀ-ӿ.!?])\s*(?=[぀-ヿ㐀-鿿])|(?<=[A-Za-zÀ-ÿ.!?])\s+(?=[Ѐ-ӿ])|(?<=[Ѐ-ӿ.!?])\s+(?=[A-Za-zÀ-ÿ])")


def prose(text: str) -> str:
    """The text without code, links, file names and figures in brackets."""
    t = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n").replace("\x85", "\n")
    # (patterns whose fixed part is missing are not run)
    if "```" in t or "~~~" in t:
        t = _FENCE.sub("\n", t)
    t = html.unescape(_HTML_CODE.sub(" ", t) if "<" in t else t)
    if "`" in t:
        t = _INLINE.sub(" ", t)
    if "](" in t:
        t = _MARKUP_LINK.sub(" ", t)
    if "://" in t or "www." in t.lower():
        t = _LINK.sub(" ", t)
    lines, code = [], False
    for line in t.split("\n"):
        if _PLAINLY_CODE.search(line):
            code = True
        elif _SENTENCE.search(line):
            code = False
        else:
            code = bool(_CODE_LINE.search(line)) or (code and line.startswith(("    ", "\t")))
        lines.append("" if code else line)
    t = "\n".join(lines)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "(" in t or "[" in t:
        t = _PAREN_NUMBERS.sub(" ", t)
    return _FILE.sub(" ", t) if _MAY_BE_FILE.search(t) else t


def segments(text: str | None) -> list[str]:
    """Sentences of the prose of a text, in order; script changes end one too."""
    if not text or not text.strip():
        return []
    out = []
    for piece in _END.split(prose(text)):
        for part in _TURN.split(piece) if _MAY_TURN.search(piece) else (piece,):
            part = part.strip()
            if part and (_WORD.search(part) or _DENSE.search(part)):
                out.append(part)
    return out


def units_of(segment: str) -> tuple[int, int]:
    """Words and dense characters of a segment."""
    dense = len(_DENSE.findall(segment))
    return (0 if dense else len(_WORD.findall(segment))), dense


# ---------------------------------------------------------------- the kernel


def marks(texts: list[str]) -> np.ndarray:
    """0/1 matrix of hashed n-grams."""
    x = np.zeros((len(texts), DIMENSIONS), np.float32)
    codes, rows = [], []
    for i, t in enumerate(texts):
        t = " " + _NOT_LETTERS.sub(" ", t.lower()).strip() + " "
        c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        codes.append(c)
        rows.append(np.full(len(c), i))
    if not codes:
        return x
    c, r = np.concatenate(codes), np.concatenate(rows)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        # h[k] runs over the n codes from k; a window that crosses into the next text is left out
        m = len(c) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint64(1000003)) ^ (c[n - 1 :] + np.uint64(n))
        if n in GRAMS:
            ok = r[:m] == r[n - 1 :]
            z = h * np.uint64(0x9E3779B97F4A7C15)
            x[r[:m][ok], (z[ok] >> np.uint64(40)) % np.uint64(DIMENSIONS)] = 1.0
    return x


def presence(texts: list[str]) -> np.ndarray:
    """The same, each row divided by the root of its size."""
    x = marks(texts)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1.0))
    return x


@dataclass
class Model:
    """Landmarks and weights; a few MB whatever the corpus.

    The map is linear: landmarks and weights are folded into one matrix with a column
    for each language, so that scoring is one narrow product a batch.
    """

    landmarks: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        # the last column counts
        self.folded = np.concatenate([self.landmarks.T @ self.weights, np.ones((DIMENSIONS, 1), np.float32)], 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        """One column for each language; the largest is the choice."""
        out = [np.zeros((0, len(LANGUAGES)), np.float32)]
        for s in range(0, len(texts), BATCH):
            y = marks(texts[s : s + BATCH]) @ self.folded
            out.append(y[:, :-1] / np.sqrt(np.maximum(y[:, -1:], 1.0)))
        return np.concatenate(out)

    def classify(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each segment; scripts of one language settle it."""
        score = self.scores(texts)
        for i, t in enumerate(texts):
            kana, han, cyr = bool(_KANA.search(t)), bool(_HAN.search(t)), bool(_CYRILLIC.search(t))
            allowed = ["ja"] if kana else ["ja", "zh"] if han else ["ru"] if cyr else [x for x in LANGUAGES if x not in ("ja", "zh", "ru")]
            mask = np.array([x not in allowed for x in LANGUAGES])
            score[i, mask] = -2.0
        p = np.exp(8.0 * (score - score.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = score.argmax(1) if len(texts) else np.zeros(0, int)
        return [LANGUAGES[k] for k in best], p.max(1) if len(texts) else np.zeros(0)


def _solve(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> Model:
    landmarks = np.concatenate([rng.choice(np.flatnonzero(labels == k), min(LANDMARKS, (labels == k).sum()), replace=False) for k in range(len(LANGUAGES)) if (labels == k).any()])
    x = presence(texts)
    low = x[landmarks]
    values, vectors = np.linalg.eigh((low @ low.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ low.T).astype(np.float64) @ root
    # each language weighs the same, however many of its segments are in the sample
    count = np.bincount(labels, minlength=len(LANGUAGES)).astype(float)
    w = 1.0 / np.maximum(count[labels], 1.0)
    y = np.where(labels[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0 / (len(LANGUAGES) - 1))
    a = phi.T @ (phi * w[:, None])
    ridge = RIDGE * np.trace(a) / len(a)
    beta = np.linalg.solve(a + ridge * np.eye(len(a)), phi.T @ (y * w[:, None]))
    return Model(low.astype(np.float32), (root @ beta).astype(np.float32))


def fit(labelled: list[tuple[str, str]], rounds: int = 3, seed: int = 7) -> Model:
    """Fits on (language, text) of labelled documents, some of them wrong or mixed.

    Segments whose label the model of the round before rejects are left out.
    """
    rng = np.random.default_rng(seed)
    texts: list[str] = []
    labels: list[int] = []
    for lang, text in labelled:
        for s in segments(text):
            words, dense = units_of(s)
            if (dense >= 6) if lang in NO_SPACES else (words >= 4 and not dense):
                texts.append(s)
                labels.append(LANGUAGES.index(lang))
    if not texts:
        raise ValueError("no labelled prose to fit on")
    y = np.array(labels)
    pick = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:SAMPLE_SEGMENTS] for k in range(len(LANGUAGES))])
    texts, y = [texts[i] for i in pick], y[pick]
    # accents are often left out, so each segment also trains without them
    bare = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) if not _DENSE.search(t) else t for t in texts]
    texts, y = texts + bare, np.concatenate([y, y])
    keep = np.ones(len(y), bool)
    model = _solve(texts, y, rng)
    for _ in range(rounds - 1):
        got = model.scores(texts).argmax(1)
        keep = got == y
        chosen = [t for t, k in zip(texts, keep) if k]
        model = _solve(chosen, y[keep], rng)
    return model


def training_rows(documents: DataFrame) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS labelled texts for each language, the same ones at every run.

    The sample is bounded by its parameters; rows are thinned by a hash before the
    per-language choice, so no language is gathered whole.
    """
    d = documents.select("doc_id", label_of(F.col("lang")).alias("label"), "text").filter(F.col("label").isNotNull() & (F.length("text") >= 60))
    count = {r["label"]: r["n"] for r in d.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # about four times the sample passes; small languages pass whole
    share = F.create_map(*[F.lit(x) for k, n in count.items() for x in (k, min(1.0, 4.0 * SAMPLE_DOCS / n))]) if count else None
    if share is None:
        return []
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0
    few = d.withColumn("_h", h).filter(F.col("_h") < F.element_at(share, F.col("label")))
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id"))).filter(F.col("_r") <= SAMPLE_DOCS)
    return [(r["label"], r["text"]) for r in few.select("label", "text").collect()]


# ---------------------------------------------------------------- documents

SEGMENTS = "doc_id bigint, label string, segment int, lang string, confidence double, words int, chars int"


def runs_of(languages: list[str], sizes: list[tuple[int, int]], sure: np.ndarray) -> list[tuple[str, float, int, int]]:
    """Joins neighbouring segments of one language: (language, confidence, words, dense characters)."""
    runs: list[list] = []
    for lang, (words, dense), p in zip(languages, sizes, sure):
        weight = words + dense
        if runs and runs[-1][0] == lang:
            runs[-1][1] += p * weight
            runs[-1][2] += words
            runs[-1][3] += dense
        else:
            runs.append([lang, p * weight, words, dense])
    return [(lang, float(p / max(1, w + c)), w, c) for lang, p, w, c in runs]


def label_segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, segment, lang, confidence, words, chars): runs of prose in one language.

    label is the language the document's own label names, or NULL. Texts that are null,
    empty, blank or without prose give no segments. Texts are handled whole, in batches
    of segments, however long they are. Repeated rows give repeated segments.
    """
    spark = documents.sparkSession
    if model is None:
        rows = training_rows(documents)
        if not rows:
            return spark.createDataFrame([], SEGMENTS)
        model = fit(rows)
    shared = spark.sparkContext.broadcast(model)

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for big in batches:
            for start in range(0, len(big), 200):
                batch = big.iloc[start : start + 200]
                split = [segments(t) for t in batch["text"]]
                flat = [s for x in split for s in x]
                unique = sorted(set(flat))
                position = {s: i for i, s in enumerate(unique)}
                langs, sure = shared.value.classify(unique)
                rows = []
                for doc_id, label, parts in zip(batch["doc_id"], batch["label"], split):
                    at = [position[s] for s in parts]
                    sizes = [units_of(s) for s in parts]
                    named = [langs[i] for i in at]
                    conf = sure[at] if at else np.zeros(0)
                    # a fragment of one or two words beside sentences of one language is theirs
                    for i, (w, c) in enumerate(sizes):
                        if not c and w < 3 and conf[i] < 0.6:
                            near = [named[j] for j in (i - 1, i + 1) if 0 <= j < len(named)]
                            if near and len(set(near)) == 1 and near[0] not in NO_SPACES:
                                named[i] = near[0]
                    for k, (lang, p, w, c) in enumerate(runs_of(named, sizes, conf)):
                        rows.append((doc_id, label, k, lang, p, w, c))
                yield pd.DataFrame(rows, columns=["doc_id", "label", "segment", "lang", "confidence", "words", "chars"])

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), label_of(F.col("lang")).alias("label"), F.col("text")).filter(F.col("text").isNotNull() & (F.trim("text") != ""))
    return d.mapInPandas(classify, SEGMENTS)


def document_languages(segs: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, words, chars): each language that counts in each document."""
    dense = F.col("lang").isin(*NO_SPACES)
    runs = segs.filter(F.when(dense, F.col("chars") >= LEAST_CHARS).otherwise(F.col("words") >= LEAST_WORDS))
    return runs.groupBy("doc_id", "lang").agg(F.first("label").alias("label"), F.avg("confidence").alias("confidence"), F.sum("words").alias("words"), F.sum("chars").alias("chars"))


def found(segs: DataFrame) -> DataFrame:
    """Documents whose label doesn't name exactly the languages that count: (doc_id, lang)."""
    per = document_languages(segs).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"), F.first("label").alias("label"))
    wrong = per.filter((F.size("langs") > 1) | F.col("label").isNull() | (F.col("langs")[0] != F.col("label")))
    return wrong.select("doc_id", F.explode("langs").alias("lang"))
