"""Language of texts, and of the spans of mixed ones.

The script of a word (by ranges of code points) narrows the languages that can be meant to those that were seen
in that script. Every word gets a score for each of them from hashed letter trigrams, learned
from labelled texts, and Viterbi decoding with a penalty for switching labels the words: runs of words
in one language are spans. The text's language is the one with the most letters in its words.

Texts are decoded a batch at a time, in step: at word t all texts that are that long move on together.
Training is bounded: ``PER_LANG`` documents of each language, chosen by a hash, up to ``SAMPLE_BYTES`` in all; there may
be any number of languages. Scoring is one pass without shuffle; a text takes about 5 bytes a word and language. Edge cases: a null text, or one without a letter, is ``und`` with score 0; a word in a script that no
language was seen in keeps the languages of its neighbours; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquill.llm import _bytes
from relquill.llm._shared import crc_mod, prepare, read_table, sampled_ids, sampled_texts

BITS = 16
PER_LANG = 1200
SWITCH = 12.0
UNKNOWN = "und"
#: Scores of letters held at once, and words' scores of a run of short texts.
CELLS = 1 << 23

#: First code points of ranges, and the script each range is in; letters outside Latin that share no language group as "other".
_RANGES = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x750, "arabic"), (0x780, "other"), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"),
    (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"),
    (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C00, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({s for _, s in _RANGES})
_FIRST = np.array([a for a, _ in _RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in _RANGES], np.int8)

_bmp: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _bmp:
        _bmp.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _bmp[0]


@dataclass
class Words:
    """The words with letters of a run of texts."""

    owner: np.ndarray
    start: np.ndarray  # code points in the joined run
    end: np.ndarray
    n_letters: np.ndarray
    script: np.ndarray
    gram: np.ndarray  # hashed trigrams, by word
    gram_word: np.ndarray
    offset: np.ndarray  # where each text starts


def words_of(texts: list) -> Words:
    """Runs of letters with their scripts and trigrams (marks at both ends of a word count as letters)."""
    parts = [(t or "") for t in texts]
    code = np.frombuffer("\n".join(parts).lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len("\n".join(parts)) != len(code):  # lower case of a few letters is longer: fall back to one by one
        code = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in "\n".join(parts)], np.int64)
    is_letter = np.zeros(len(code) + 2, bool)
    is_letter[1:-1] = letters()[code]
    edge = np.flatnonzero(is_letter[1:] != is_letter[:-1])
    start, end = edge[0::2], edge[1::2]
    offset = np.cumsum([0] + [len(p) + 1 for p in parts])[:-1]
    owner = np.searchsorted(offset, start, "right") - 1
    padded = np.zeros(len(code) + 2, np.uint64)
    padded[1:-1] = np.where(is_letter[1:-1], code, 0).astype(np.uint64)
    at = np.flatnonzero(is_letter[1:-1])
    with np.errstate(over="ignore"):
        a, b, c = padded[at], padded[at + 1], padded[at + 2]
        gram = _bytes.mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c) >> np.uint64(64 - BITS)
    script = _SCRIPT[np.searchsorted(_FIRST, code[start], "right") - 1] if len(start) else np.zeros(0, np.int8)
    word = np.repeat(np.arange(len(start)), end - start)
    return Words(owner, start, end, end - start, script, gram.astype(np.int64), word, offset)


def _runs(texts: list, most: int = 1 << 21) -> Iterator[list]:
    """The texts in runs of about ``most`` characters."""
    held, size = [], 0
    for t in texts:
        n = len(t or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # 2**BITS x languages: log probability of a trigram
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, w: Words) -> np.ndarray:
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        first = np.concatenate([[0], np.cumsum(w.n_letters)[:-1]])
        total = np.empty((len(w.start), len(self.langs)), np.float32)
        ends = np.append(first[1:], len(w.gram))
        lo, most = 0, max(1, CELLS // max(1, len(self.langs)))
        while lo < len(first):  # letters x languages are held in bounded slices
            hi = max(lo + 1, int(np.searchsorted(ends, first[lo] + most, "right")))
            total[lo:hi] = np.add.reduceat(self.table[w.gram[first[lo] : ends[hi - 1]]], first[lo:hi] - first[lo], axis=0)
            lo = hi
        ok = self.allowed[w.script]
        ok = ok | ~ok.any(axis=1, keepdims=True)
        total = np.where(self.allowed.any(axis=0) & ~self.allowed[w.script].any(axis=1, keepdims=True), 0, total)
        return np.where(ok, total, total - 1e4).astype(np.float32)

    def labels(self, w: Words, switch: float = SWITCH) -> np.ndarray:
        """The language of each word, by Viterbi over each text's words."""
        score, k = self.word_scores(w), len(self.langs)
        out = np.zeros(len(score), np.int16)
        if not len(score) or k < 2:
            return out
        texts, first, count = np.unique(w.owner, return_index=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        live = np.searchsorted(-count, -np.arange(count[0]), "left")  # texts of more than t words
        back = np.zeros((len(score), k), np.int8 if k < 128 else np.int16)
        v = score[first].copy()
        stay = np.arange(k)
        for t in range(1, count[0]):
            n = live[t]
            u = v[:n]
            best = u.argmax(axis=1)
            move = u[np.arange(n), best][:, None] - switch
            jump = move > u
            at = first[:n] + t
            back[at] = np.where(jump, best[:, None], stay)
            v[:n] = np.where(jump, move, u) + score[at]
        state = v.argmax(axis=1)
        for t in range(count[0] - 1, -1, -1):
            n = live[t]
            at = first[:n] + t
            out[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        """(language, share of letters in it) of each text."""
        names, shares = [], []
        for part in _runs(texts, max(1 << 12, CELLS // max(4, len(self.langs)))):
            w = words_of(part)
            size = np.zeros((len(part), max(1, len(self.langs))))
            if self.langs:
                np.add.at(size, (w.owner, self.labels(w)), w.n_letters)
            total = size.sum(axis=1)
            best = size.argmax(axis=1)
            names += [self.langs[b] if t else UNKNOWN for b, t in zip(best, total, strict=True)]
            shares.append(np.where(total > 0, size[np.arange(len(part)), best] / np.maximum(total, 1), 0.0))
        return names, np.concatenate(shares) if shares else np.zeros(0)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) in code points of each run of words in one language."""
        w = words_of([text])
        out: list[tuple[int, int, str]] = []
        for s, e, x in zip(w.start.tolist(), w.end.tolist(), self.labels(w).tolist(), strict=True):
            if out and out[-1][2] == self.langs[x]:
                out[-1] = (out[-1][0], e, self.langs[x])
            else:
                out.append((s, e, self.langs[x]))
        return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """Learns from (language, text)."""
    texts: dict[str, list[str]] = {}
    for lang, t in rows:
        texts.setdefault(lang, []).append(t)
    langs = sorted(texts)
    counts = np.zeros((1 << BITS, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    for j, lang in enumerate(langs):
        own = texts[lang]
        for part in _runs(own):
            w = words_of(part)
            counts[:, j] += np.bincount(w.gram, minlength=1 << BITS)
            scripts[:, j] += np.bincount(w.script, w.n_letters, len(SCRIPTS))
    share = counts / np.maximum(counts.sum(axis=0), 1)
    mean = share.mean(axis=1, keepdims=True)
    smooth = (counts + 50 * mean + 1e-3) / (counts.sum(axis=0) + 50 + 1e-3 * (1 << BITS))
    return Model(langs, np.log(smooth).astype(np.float32), scripts >= np.maximum(1, 0.002 * scripts.sum(axis=0)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on rows of ``docs`` that the caller may learn from."""
    slim = docs.select(id_col, F.col(lang_col).cast("string").alias("__l"))
    sample = sampled_ids(slim, id_col, "__l", PER_LANG)
    langs = sorted({x for _, x in sample})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    numbered = [(i, langs.index(x)) for i, x in sample]
    return fit(sorted((langs[label], t) for label, _, t in sampled_texts(docs, numbered, id_col, text_col)))


def languages(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: id, held_out, lang_pred, score. Rows for which ``held_out`` (a column of the id) is true teach nothing."""
    spark = docs.sparkSession
    prepare(spark, 1024)  # more texts in step make fewer steps
    sent = spark.sparkContext.broadcast(train(docs.where(~held_out), id_col, text_col, lang_col))

    @F.pandas_udf("lang_pred string, score double")
    def named(texts: pd.Series) -> pd.DataFrame:
        lang, share = sent.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": share})

    out = docs.select(F.col(id_col), held_out.alias("held_out"), named(F.col(text_col).cast("string")).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a quarter of the ids, by crc32, is held out."""
    return languages(read_table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2)
