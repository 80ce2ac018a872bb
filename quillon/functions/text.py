"""Search terms: tokens, stop words and a Spanish stemmer after the published Snowball rules."""

from __future__ import annotations

import re
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

TOKEN = "([a-záéíóúñü]+)"
#: What parts words, and texts that are counted at once.
OUTSIDE, TEXTS = "[^a-záéíóúñü]+", 1024
VOWELS = "aeiouáéíóúü"
#: The 608 Spanish words that a full-text search leaves out.
STOPWORDS = files(__package__).joinpath("stoplist_es.txt").read_text("utf-8").split()
#: How a full-text search makes terms, unless told otherwise.
SPANISH = {"stopwords": STOPWORDS, "stem": True}


def tokens(text: Column) -> Column:
    """Runs of Spanish letters in lower case; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def _after_first(word: str, start: int) -> int:
    """Behind the first non-vowel that follows a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _rv(word: str) -> int:
    if len(word) < 3:
        return len(word)
    if word[1] not in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] in VOWELS), len(word))
    if word[0] in VOWELS:
        return next((i + 1 for i in range(2, len(word)) if word[i] not in VOWELS), len(word))
    return 3


def _longest(word: str, suffixes: list[str]) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


# fixed values: the suffixes of the published Spanish Snowball algorithm
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
PLAIN_VERBS = "ando iendo ar er ir".split()
DELETED = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias acion".split()
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
E_VERBS = "en es éis emos".split()
VERBS = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()
RESIDUALS = "os a o á í ó".split()


def stem_es(word: str) -> str:
    """The Spanish stem of a word in lower case."""
    rv = _rv(word)
    r1 = _after_first(word, 0)
    r2 = _after_first(word, r1)
    # step 0: attached pronouns behind a verb ending in RV
    s = _longest(word, PRONOUNS)
    if s and len(word) - len(s) >= rv:
        before = word[: len(word) - len(s)]
        verb = _longest(before[rv:], [*GERUNDS, *PLAIN_VERBS, "yendo"])
        if verb in GERUNDS:
            word = before[: len(before) - len(verb)] + GERUNDS[verb]
        elif verb and (verb != "yendo" or before.endswith("uyendo")):
            word = before
    # step 1: standard suffixes
    start = word

    def drop(n: int, instead: str = "") -> None:
        nonlocal word
        word = word[: len(word) - n] + instead

    def then(*more: str) -> None:
        t = _longest(word, list(more))
        if t and len(word) - len(t) >= r2:
            drop(len(t))

    known = {**dict.fromkeys(DELETED, "del"), **dict.fromkeys(AGENTS, "ic"), "logía": "log", "logías": "log", "ución": "u", "uciones": "u", "ucion": "u", "encia": "ente", "encias": "ente", "amente": "am", "mente": "men", "idad": "id", "idades": "id", "iva": "iv", "ivo": "iv", "ivas": "iv", "ivos": "iv"}
    s = _longest(word, list(known))
    kind = known.get(s)
    if kind == "am":
        if len(word) - len(s) >= r1:
            drop(len(s))
            if word.endswith("iv") and len(word) - 2 >= r2:
                drop(2)
                then("at")
            else:
                then("os", "ic", "ad")
    elif kind and len(word) - len(s) >= r2:
        drop(len(s), {"log": "log", "u": "u", "ente": "ente"}.get(kind, ""))
        if kind == "ic":
            then("ic")
        elif kind == "men":
            then("ante", "able", "ible")
        elif kind == "id":
            then("abil", "ic", "iv")
        elif kind == "iv":
            then("at")
    if word == start:  # step 2: verb suffixes
        s = _longest(word[rv:], Y_VERBS)
        if s and word[: len(word) - len(s)].endswith("u"):
            drop(len(s))
        else:
            s = _longest(word[rv:], VERBS + E_VERBS)
            if s:
                drop(len(s))
                if s in E_VERBS and word.endswith("gu"):
                    drop(1)
    # step 3: residual suffixes
    s = _longest(word[rv:], [*RESIDUALS, "e", "é"])
    if s in RESIDUALS:
        drop(len(s))
    elif s:
        drop(1)
        if word.endswith("gu") and len(word) - 1 >= rv:
            drop(1)
    return word.translate(str.maketrans("áéíóú", "aeiou"))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a scan of few files has fewer parts than those.

    Tables of as many files as cores stay as they are, and aren't planned for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = len(df.inputFiles()) < cores and df.rdd.getNumPartitions() < cores
    return df.repartition(cores) if few else df


class _Words:
    """Numbers the terms of whole batches of texts; a worker meets a word's stem once."""

    def __init__(self, stopwords: list[str], stem: bool):
        self.left_out, self.stem, self.known = {"", *stopwords}, stem, {}

    def root(self, word: str) -> str:
        if not self.stem:
            return word
        if len(self.known) > 500_000:
            self.known.clear()
        return self.known.get(word) or self.known.setdefault(word, stem_es(word))

    def numbered(self, lower: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Terms, the number of each word's term in order, and the text of each word."""
        split = pc.split_pattern_regex(lower, OUTSIDE)
        flat = split.flatten().dictionary_encode()
        number: dict[str, int] = {}
        code = [-1 if w in self.left_out else number.setdefault(self.root(w), len(number)) for w in flat.dictionary.to_pylist()]
        codes = np.array(code, np.int64)[flat.indices.to_numpy()] if code else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
        return list(number), codes[codes >= 0], owner[codes >= 0]


def _lower(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.lower(text_col).alias("text"))
    return spread(known)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def counts(docs: DataFrame, id_col: str, text_col: str, asked: list[str], stopwords: list[str] = (), stem: bool = False) -> DataFrame:
    """``doc, len, tf``: a text's number of words, and how often each asked term stands in it. Null texts have no row."""

    def count(batches):
        words = _Words(stopwords, stem)
        for part in _slices(batches):
            names, codes, owner = words.numbered(part["text"])
            n, place = part.num_rows, {t: i for i, t in enumerate(names)}
            tf = np.stack([np.bincount(owner[codes == place.get(t, -1)], minlength=n) for t in asked], 1) if asked else np.zeros((n, 0), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(asked), pa.int32()), pa.array(tf.reshape(-1), pa.int64()))
            yield pa.record_batch({"doc": part["doc"], "len": pa.array(np.bincount(owner, minlength=n), pa.int64()), "tf": lists})

    read = _lower(docs, id_col, text_col)
    return read.mapInArrow(count, T.StructType([read.schema["doc"], T.StructField("len", T.LongType()), T.StructField("tf", T.ArrayType(T.LongType()))]))


def terms(docs: DataFrame, id_col: str, text_col: str, stopwords: list[str] = (), stem: bool = False, among: list[str] | None = None) -> DataFrame:
    """``doc, term, tf``: the bag of words of each text, counted where the text is read: no shuffle.

    With ``among`` only of texts that hold one of those terms.
    """

    def count(batches):
        words = _Words(stopwords, stem)
        for part in _slices(batches):
            names, codes, owner = words.numbered(part["text"])
            if among is not None:
                hit = np.zeros(part.num_rows, bool)
                hit[owner[np.isin(codes, [i for i, t in enumerate(names) if t in among])]] = True
                codes, owner = codes[hit[owner]], owner[hit[owner]]
            pair, tf = np.unique(owner * max(len(names), 1) + codes, return_counts=True)
            doc, term = np.divmod(pair, max(len(names), 1))
            yield pa.record_batch({"doc": part["doc"].take(pa.array(doc)), "term": pa.array(names, pa.string()).take(pa.array(term)), "tf": pa.array(tf, pa.int64())})

    read = _lower(docs, id_col, text_col)
    return read.mapInArrow(count, T.StructType([read.schema["doc"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def query_terms(text: str, stopwords: list[str] = (), stem: bool = False) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in re.findall(TOKEN, text.lower()):
        if w not in stopwords:
            w = stem_es(w) if stem else w
            out[w] = out.get(w, 0) + 1
    return out
