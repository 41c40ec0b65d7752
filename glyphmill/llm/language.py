"""Missing or wrong document language labels (problem 8): segmentation-marginalised unigrams.

Each language gives every piece of a fixed public vocabulary a probability. A word's probability is the sum over all
its segmentations into pieces, by a forward pass; a sentence's is the product over its words. The probabilities are
fitted by expectation maximisation on a bounded sample of labelled documents.
"""

from __future__ import annotations

import functools
import html
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.tokens import TOKENIZERS

#: Languages told apart.
LANGUAGES = ("de", "en", "es", "fr", "ja", "nl", "pt", "ru")
#: Usual spellings of a label besides the code and the code with a region.
SPELLINGS = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "ja": ("jpn", "japanese"),
    "nl": ("nld", "dut", "dutch"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
}
#: The model is fitted on this many labelled documents of each language, of SAMPLE_CHARS characters, in the order of a
#: hash of their ids, and in them on words of up to SAMPLE_LETTERS letters.
SAMPLE_ROWS = 750
SAMPLE_LETTERS = 64
SAMPLE_CHARS = (20, 5_000)
#: Rounds of expectation maximisation, and of relabelling the sample's sentences by the model fitted so far.
EM_ROUNDS = 2
RELABEL_ROUNDS = 2
#: What the label of a sample's document counts for in the language of its sentences, as a natural logarithm.
LABEL_TRUST = 6.0
#: What a change of language between two sentences costs, as a natural logarithm; it keeps sentences that say little
#: in the language around them.
SWITCH = 4.0

#: Words up to this length are kept with their lattices; longer ones are rare and worked out anew.
_KEPT_LETTERS = 64
_UNKNOWN = 1e-7

_HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_TAG = re.compile(r"<\|?/?[a-z_]+\|?>", re.I)
_FENCE = re.compile(r"\s*(?:`{3}|\"{3}|'{3})")
_BULLET = re.compile(r"^\s*(?:[*•\-+]|\d+[.)])\s+")
#: Lines without a language: headings, error positions, signatures, and code.
_HEADING = re.compile(r"\s*(?:#|[A-Za-z]{2}\d{3,}\s*@)")
_SIGNATURE = ("→", "->", "<expr>", "{block}")
_CODE = re.compile(
    r"\s*(?:(?:var(?:ip)?\s+)?(?:float|int|bool|string|color)?\s*\w+\s*:?=(?!=)\s|(?:plot|alert|label\s*\.\s*new|strategy|indicator|fill|hline|bgcolor)\s*\(|for\s+\w+\s*=|if\s+\w+\s*[<>=!]|var\s|import\s|export\s)", re.I
)
#: Symbol names (dotted, with an @, in mixed case, or called), strings with digits, and addresses; ASCII only, as the
#: text around may follow without a space.
_ID = r"[A-Za-z_][A-Za-z0-9_]*+"
_NAME = regex.compile(rf"https?://\S+|@?{_ID}(?:\.{_ID})+(?:\(\s*\))?|@{_ID}|(?<![A-Za-z0-9_])[A-Za-z_]*[0-9][A-Za-z0-9_]*|(?<![A-Za-z])[A-Za-z]*[a-z][A-Z]{_ID}(?:\(\s*\))?|{_ID}\(\s*\)")
#: What stands between white space and signs; a full stop may be inside a name.
_CLUMP = re.compile(r"[^\s\"'`«»“”‘’,;:!?、。！？…(){}\[\]<>/|&*=+%#~^$\-–—]+")
_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]`]*\s+|(?<=[。！？])")
_WORD = regex.compile(r"\p{Hiragana}+|[\p{Katakana}ー]+|\p{Han}+|(?:(?![\p{Hiragana}\p{Katakana}\p{Han}])[\p{L}\p{M}])+")
_LETTER = regex.compile(r"\p{L}")
_CJK = regex.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")


def label_code(label: Column) -> Column:
    """The language a label names, in any usual spelling (code, code with region, English name); null if none."""
    bare = F.lower(F.regexp_replace(label, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    code = F.regexp_extract(bare, r"^([a-z]{2})(?:[-_][a-z0-9]{2,8})*$", 1)
    out = F.when(code.isin(*LANGUAGES), code)
    for language, names in SPELLINGS.items():
        out = out.when(bare.isin(*names), language)
    return out


def sentences(text: str | None) -> list[str]:
    """The sentences of a text in order. Code, headings, error positions and signs are none; comments in code are."""
    if not text:
        return []
    text = _HIDDEN.sub("", html.unescape(text) if "&" in text else text).replace("\u00a0", " ")
    text = _TAG.sub(" ", text) if "<" in text else text
    out, fenced = [], False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            continue
        bare = line.strip()
        if bare.startswith("//"):
            bare = bare.lstrip("/ ")
        elif fenced or _HEADING.match(line) or _CODE.match(line) or any(mark in line for mark in _SIGNATURE):
            continue
        else:
            bare = _BULLET.sub("", bare)
        out += [s for s in _END.split(bare) if s and _LETTER.search(s)]
    return out


def clump_words(clump: str) -> list[str]:
    """The words of what stands between white space and signs, in lower case: none for names, numbers and long strings."""
    bare = clump.strip(".")
    if bare.isascii():
        plain = bare.isalpha() and (bare.islower() or bare.isupper() or bare[1:].islower())
        return [bare.lower()] if plain else []
    if bare.isalpha() and not _CJK.search(bare):
        return [bare.lower()]
    return [w.lower() for w in _WORD.findall(_NAME.sub(" ", bare))]


def words(sentence: str) -> list[str]:
    """The words of a sentence in lower case, without symbol names, numbers and signs; Japanese is cut where the script changes."""
    return [w for clump in _CLUMP.findall(sentence) for w in clump_words(clump)]


@functools.lru_cache(maxsize=2)
def vocabulary(tokenizers: str = TOKENIZERS, name: str = "piece_bpe_32k") -> dict[str, int]:
    """Pieces of the public vocabulary with their numbers; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(tokenizers, f"{name}.model"))
    return {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


@functools.lru_cache(maxsize=2)
def longest_piece(tokenizers: str = TOKENIZERS) -> int:
    """Characters of the longest piece of the vocabulary."""
    return max(map(len, vocabulary(tokenizers)))


def _edges(text: str, tokenizers: str) -> Iterator[tuple[int, int, int]]:
    """Edges (start, end, piece) in the order of their starts; -1 stands for a character outside the vocabulary."""
    pieces, longest = vocabulary(tokenizers), longest_piece(tokenizers)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            k = pieces.get(text[i:j])
            if k is not None:
                yield i, j, k
            elif j == i + 1:
                yield i, j, -1


def _spelled(word: str) -> str:
    return word if _CJK.match(word) else "▁" + word


@functools.lru_cache(maxsize=300_000)
def _lattice(word: str, tokenizers: str) -> tuple[int, list[tuple[int, int, int]]]:
    """Length and edges of a word of at most _KEPT_LETTERS letters."""
    text = _spelled(word)
    return len(text), list(_edges(text, tokenizers))


class Unigrams:
    """Per-language piece probabilities; ``table`` has a row per piece number and a column per language."""

    def __init__(self, table: np.ndarray, languages: tuple[str, ...], tokenizers: str = TOKENIZERS):
        self.table, self.languages, self.tokenizers = table, languages, tokenizers
        self._forget()

    def _forget(self) -> None:
        """What is known of words and clumps; row 0 stands for a clump without words."""
        self.known: dict[str, np.ndarray] = {}
        self.clumps: dict[str, int] = {}
        self.rows = np.zeros((1_024, len(self.languages)))
        self.filled = 1

    def __getstate__(self):
        return {"table": self.table, "languages": self.languages, "tokenizers": self.tokenizers}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _p(self, k: int):
        return self.table[k] if k >= 0 else _UNKNOWN

    def word(self, word: str) -> np.ndarray:
        """Logarithm of the word's probability in each language, summed over all its segmentations."""
        if len(word) > _KEPT_LETTERS:
            return self._long_word(word)
        found = self.known.get(word)
        if found is None:
            n, edges = _lattice(word, self.tokenizers)
            alpha = np.zeros((n + 1, len(self.languages)))
            alpha[0] = 1.0
            for i, j, k in edges:  # in the order of their starts, so alpha[i] is complete
                alpha[j] += alpha[i] * self._p(k)
            found = np.log(np.maximum(alpha[n], 1e-300))
            self.known[word] = found
        return found

    def _long_word(self, word: str) -> np.ndarray:
        """``word`` of any length: what becomes too small for a number is scaled up, language by language."""
        text, longest = _spelled(word), longest_piece(self.tokenizers)
        alpha = np.zeros((len(text) + 1, len(self.languages)))
        alpha[0], scale, at = 1.0, np.zeros(len(self.languages)), -1
        for i, j, k in _edges(text, self.tokenizers):
            if i != at:
                at, small = i, alpha[i] < 1e-150
                if small.any():
                    alpha[i : i + longest + 1, small] *= 1e150
                    scale[small] -= np.log(1e150)
            alpha[j] += alpha[i] * self._p(k)
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale

    def _learn(self, clump: str) -> int:
        """The row of a clump not met before."""
        said = clump_words(clump)
        at = 0
        if said:
            if self.filled == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            at, self.filled = self.filled, self.filled + 1
            self.rows[at] = np.sum([self.word(w) for w in said], axis=0)
        self.clumps[clump] = at
        return at

    def scores(self, told: list[str]) -> tuple[np.ndarray, list[int]]:
        """Log-probabilities of the words of each sentence that has any, and the places of those sentences."""
        if len(self.clumps) > 300_000:
            self._forget()
        ids, starts, kept, get = [], [], [], self.clumps.get
        for place, sentence in enumerate(told):
            at = len(ids)
            for clump in _CLUMP.findall(sentence):
                row = get(clump)
                if row is None:
                    row = self._learn(clump)
                if row:
                    ids.append(row)
            if len(ids) > at:
                starts.append(at)
                kept.append(place)
        return (np.add.reduceat(self.rows[ids], starts, axis=0) if kept else np.empty((0, len(self.languages)))), kept

    def expected(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """Expected uses of every piece per language, over all segmentations of the counted words."""
        uses = np.zeros_like(self.table)
        for word, weight in counts.items():
            n, edges = _lattice(word, self.tokenizers)
            alpha = np.zeros((n + 1, len(self.languages)))
            beta = np.zeros((n + 1, len(self.languages)))
            alpha[0] = beta[n] = 1.0
            for i, j, k in edges:
                alpha[j] += alpha[i] * self._p(k)
            for i, j, k in reversed(edges):
                beta[i] += beta[j] * self._p(k)
            scale = weight / np.maximum(alpha[n], 1e-300)
            for i, j, k in edges:
                if k >= 0:
                    uses[k] += alpha[i] * self.table[k] * beta[j] * scale
        return uses


def _smoothed(uses: np.ndarray) -> np.ndarray:
    """Probabilities from uses; every piece keeps a little of what it has over all languages, and a floor."""
    shared = uses.sum(axis=1, keepdims=True) / max(uses.sum(), 1.0)
    return (uses + 20.0 * shared + 0.01) / (uses.sum(axis=0) + 20.0 + 0.01 * len(uses))


def fit(labelled: list[tuple[str, str]], tokenizers: str = TOKENIZERS, em_rounds: int = EM_ROUNDS, relabel_rounds: int = RELABEL_ROUNDS, label_trust: float = LABEL_TRUST) -> Unigrams | None:
    """Unigrams from (language, text) pairs whose labels may be wrong; None without a sentence."""
    languages = tuple(sorted({code for code, _ in labelled}))
    seen = Counter((languages.index(code), s) for code, text in labelled for s in sentences(text))
    equal: Counter = Counter()  # sentences of the same words count together
    for (code, sentence), n in seen.items():
        equal[code, tuple(w for w in words(sentence) if len(w) <= SAMPLE_LETTERS)] += n
    told = [(code, found, n) for (code, found), n in equal.items() if found]
    if not told:
        return None
    size = max(vocabulary(tokenizers).values()) + 1
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for _, found, _ in told for w in found])
    lengths = np.array([len(found) for _, found, _ in told])
    starts = np.append(0, np.cumsum(lengths)[:-1])
    labels, times = np.array([code for code, _, _ in told]), np.repeat(np.array([n for _, _, n in told], float), lengths)
    codes, trust, model = labels, label_trust * np.eye(len(languages)), None
    for _ in range(1 + relabel_rounds):
        table = np.zeros((len(place), len(languages)))
        np.add.at(table, (ids, np.repeat(codes, lengths)), times)
        counts = dict(zip(place, table))
        if model is None:
            uses = np.zeros((size, len(languages)))
            for w, weight in counts.items():
                for i, j, k in _lattice(w, tokenizers)[1]:
                    if k >= 0:
                        uses[k] += weight * (j - i)
            model = Unigrams(_smoothed(uses), languages, tokenizers)
        for _ in range(em_rounds):
            model = Unigrams(_smoothed(model.expected(counts)), languages, tokenizers)
        # a wrong label, and a sentence in another language than its document, moves to where it is likeliest
        said = np.stack([model.word(w) for w in place])
        codes = np.argmax(np.add.reduceat(said[ids], starts, axis=0) + trust[labels], axis=1)
    return model


def sample(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``rows`` labelled texts of bounded length for each language: all that reaches the driver."""
    low, high = SAMPLE_CHARS
    order = Window.partitionBy("code").orderBy(F.xxhash64("_key"), "_key")  # cut to the first rows before the shuffle
    picked = (
        documents.select(F.col(key).alias("_key"), label_code(F.col(label)).alias("code"), F.col(text).alias("text"))
        .filter(F.col("code").isNotNull() & F.length("text").between(low, high))
        .withColumn("_at", F.row_number().over(order))
        .filter(F.col("_at") <= rows)
    )
    return sorted((r.code, r.text) for r in picked.select("code", "text").collect())


def stretches(text: str | None, model: Unigrams, switch: float = SWITCH) -> list[tuple[str, float, int]]:
    """(language, confidence, characters) of each run of sentences in one language, in text order.

    The languages are those of the likeliest sequence in which every change costs ``switch``. The confidence is the
    posterior of the run's language from all its sentences.
    """
    told = sentences(text)
    scores, kept = model.scores(told)
    if not kept:
        return []
    chars_of = [len(told[k].strip()) for k in kept]
    likeliest = np.argmax(scores, axis=1)
    if (likeliest == likeliest[0]).all():  # no change of language pays
        path = likeliest.tolist()
    else:
        best, back = scores[0].copy(), []
        for score in scores[1:]:
            from_any = int(np.argmax(best))
            stay = best >= best[from_any] - switch
            back.append(np.where(stay, np.arange(len(best)), from_any))
            best = np.where(stay, best, best[from_any] - switch) + score
        path = [int(np.argmax(best))]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        path.reverse()
    groups: list[list] = []
    for code, score, chars in zip(path, scores, chars_of):
        if groups and groups[-1][0] == code:
            groups[-1][1] = groups[-1][1] + score
            groups[-1][2] += chars
        else:
            groups.append([code, score, chars])
    return [(model.languages[code], 1.0 / float(np.sum(np.exp(np.minimum(score - score[code], 700.0)))), chars) for code, score, chars in groups]


def languages(documents: DataFrame, model: Unigrams | None = None, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, seg_no, lang_code, confidence, n_chars, n_segments, label_code): languages of all texts.

    seg_no 0 is the document with the language of most of its sentences' characters (ties: the first in the
    alphabet); 1, 2, … are its stretches in text order. Texts without a sentence (null, empty, blank, code alone) give
    no row. Whole texts are read, each by one task; the model is bounded by the vocabulary.
    """
    model = model or fit(sample(documents, key, text, label))
    schema = "doc_id bigint, label_code string, seg_no int, lang_code string, confidence double, n_chars bigint, n_segments int"
    source = documents.select(F.col(key).alias("doc_id"), label_code(F.col(label)).alias("label_code"), F.col(text).alias("text"))
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in schema.split(", ")]
        for frame in frames:
            out = []
            for doc_id, code, body in zip(frame["doc_id"], frame["label_code"], frame["text"]):
                found = stretches(body, model)
                if not found:
                    continue
                share: Counter = Counter()
                for language, _, chars in found:
                    share[language] += chars
                most = min(share, key=lambda x: (-share[x], x))
                sure = sum(c * n for x, c, n in found if x == most) / max(1, share[most])
                out.append((doc_id, code, 0, most, sure * share[most] / max(1, sum(share.values())), sum(share.values()), len(found)))
                out += [(doc_id, code, i + 1, *s, len(found)) for i, s in enumerate(found)]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "int64", "seg_no": "int32", "n_segments": "int32"})

    return source.mapInPandas(told, schema)


def wrong_or_mixed(told: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang_code): documents whose label is missing or wrong (seg_no 0), and the stretches of mixed ones."""
    wrong = (F.col("seg_no") == 0) & (F.col("label_code").isNull() | (F.col("label_code") != F.col("lang_code")))
    mixed = (F.col("seg_no") > 0) & (F.col("n_segments") > 1)
    return told.filter(wrong | mixed).select("doc_id", "seg_no", "lang_code")
