"""Language identification by cross-parsing against suffix automata.

For each language a suffix automaton of labelled text accepts exactly the strings that occur in it.  A
document is parsed from left to right into longest matches: the automaton is followed until no transition
is left, which ends a phrase and starts the next at the root.  A text takes few phrases against text of
its own language.  ``phrases * log2(reference length) / length`` estimates the cross entropy in bits a
letter; the language with the least wins.

Letters are compared in lower case; a run of other characters counts as one space.  Texts are parsed whole,
in pieces of ``piece`` letters, so that all pieces of a batch can take each step together, however long a
single text is; a phrase ends with its piece.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm.common import give_back, held_out

UNDETERMINED = "und"
LETTERS, TEXTS, PIECE = 24_000, 48, 512

_TABLES: dict[str, np.ndarray] = {}


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-case text; a run of characters that are no letters is one 0, none at the start."""
    if "alpha" not in _TABLES:
        _TABLES["alpha"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool)
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    alpha = _TABLES["alpha"][points]
    before = np.empty_like(alpha)
    before[:1], before[1:] = False, alpha[:-1]
    keep = alpha | before
    return np.where(alpha[keep], points[keep], 0)


@dataclass(frozen=True)
class Automaton:
    """``step[state * symbols + symbol]``: the next state, 0 if there is none; state 1 is the root."""

    language: str
    size: int
    step: np.ndarray


@dataclass(frozen=True)
class LanguageModel:
    alphabet: np.ndarray  # sorted code points; symbol 0 stands for any other letter, which matches nothing
    automata: tuple[Automaton, ...]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(np.int32)

    def phrases(self, texts: list[np.ndarray], piece: int = PIECE) -> np.ndarray:
        """Phrases of each text against each language."""
        out = np.zeros((len(texts), len(self.automata)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // piece) for t in texts])
        if not len(owner):
            return out
        every = self.symbols(np.concatenate(texts))
        starts = np.cumsum([0] + [len(t) for t in texts])
        nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
        begin = starts[owner] + nth * piece
        size = np.minimum(piece, starts[owner + 1] - begin)
        by = np.argsort(-size, kind="stable")
        begin, size, owner = begin[by], size[by], owner[by]
        # Pieces still running at each step are the first ones: they are in order of their size.
        running = np.searchsorted(-size, -np.arange(size[0]), "left")
        k = len(self.alphabet) + 1
        for a, automaton in enumerate(self.automata):
            state, count, root = np.ones(len(begin), np.int32), np.zeros(len(begin), np.int64), automaton.step[k:2 * k]
            for j, n in enumerate(running):
                symbol = every[begin[:n] + j]
                after = automaton.step[state[:n] * k + symbol]
                dead = np.flatnonzero(after == 0)
                if dead.size:
                    # The phrase ends before this letter (unless none had begun), and the letter begins the next;
                    # a letter that the reference lacks is a phrase of its own.
                    count[dead] += state[dead] != 1
                    again = root[symbol[dead]]
                    count[dead] += again == 0
                    after[dead] = np.where(again == 0, 1, again)
                state[:n] = after
            count += state != 1
            np.add.at(out[:, a], owner, count)
        return out

    def bits(self, texts: list[np.ndarray], piece: int = PIECE) -> np.ndarray:
        length = np.array([max(1, len(t)) for t in texts], float)[:, None]
        return self.phrases(texts, piece) * np.array([[math.log2(max(2, a.size)) for a in self.automata]]) / length

    def predict(self, texts: list[str | None], at_once: int = 1_000_000) -> tuple[list[str], list[float]]:
        """Language and score of each text; texts are parsed together until they have ``at_once`` letters."""
        languages, scores, held, size = [], [], [], 0
        for k, text in enumerate(texts):
            held.append(letters(text))
            size += len(held[-1])
            if size >= at_once or k + 1 == len(texts):
                found = self._predict(held)
                languages += found[0]
                scores += found[1]
                held, size = [], 0
        return languages, scores

    def _predict(self, points: list[np.ndarray]) -> tuple[list[str], list[float]]:
        if not self.automata:
            return [UNDETERMINED] * len(points), [0.0] * len(points)
        bits = self.bits(points)
        best = bits.argmin(axis=1)
        length = np.array([min(64, len(p)) for p in points], float)
        share = 1 / np.exp2((bits.min(axis=1)[:, None] - bits) * length[:, None]).sum(axis=1)
        return ([self.automata[b].language if len(p) else UNDETERMINED for b, p in zip(best, points, strict=True)],
                [float(s) if len(p) else 0.0 for s, p in zip(share, points, strict=True)])


def suffix_automaton(symbols: list[int], k: int) -> np.ndarray:
    """Transitions of the automaton that accepts the substrings of ``symbols`` (1 to ``k`` - 1; 0 never matches)."""
    step, link, length, last = [{}, {}], [0, 0], [0, 0], 1
    for c in symbols:
        if not c:
            last = 1
            continue
        if (q := step[last].get(c)) is not None and length[q] == length[last] + 1:
            last = q  # after a break the string may be known already
            continue
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, p = len(step) - 1, last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                copy = len(step) - 1
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    table = np.zeros((len(step), k), np.int32)
    for state, edges in enumerate(step):
        for c, to in edges.items():
            table[state, c] = to
    return table.reshape(-1)


def build(samples: dict[str, list[str]], letters_each: int = LETTERS, texts_each: int = TEXTS) -> LanguageModel:
    """One automaton a language from its sample texts; each text gives at most ``letters_each / texts_each * 2`` letters."""
    quota = max(1, 2 * letters_each // texts_each)
    points = {}
    for language, texts in sorted(samples.items()):
        parts, left = [], letters_each
        for text in texts:
            if left > 0 and len(p := letters(text)[:min(quota, left)]):
                parts.append(p)
                left -= len(p)
        if parts:
            points[language] = parts
    if not points:
        return LanguageModel(np.zeros(1, np.uint32), ())
    alphabet = np.unique(np.concatenate([p for parts in points.values() for p in parts]))
    model = LanguageModel(alphabet, ())
    automata = []
    for language, parts in points.items():
        joined = [s for p in parts for s in (*model.symbols(p).tolist(), 0)]  # no phrase runs from one text to the next
        automata.append(Automaton(language, sum(map(len, parts)), suffix_automaton(joined, len(alphabet) + 1)))
    return LanguageModel(alphabet, tuple(automata))


def train(docs: DataFrame, *, letters_each: int = LETTERS, texts_each: int = TEXTS) -> LanguageModel:
    """Learn from ``docs(doc_id, text, lang)``: labelled rows that are not held out.

    The references are a bounded sample: about ``8 * texts_each`` rows a language, chosen by a hash of the id,
    of which up to ``letters_each`` letters are used.  Null ids, texts and languages teach nothing.
    """
    may = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    wanted = 8 * texts_each
    share = F.lit(False)
    for r in may.groupBy("lang").count().collect():
        share = share | ((F.col("lang") == r["lang"]) & (place < min(1 << 30, (wanted << 30) // r["count"])))
    rows = may.where(share).select("lang", place.alias("place"), F.substring("text", 1, 8 * letters_each // texts_each).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.place, r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return build(samples, letters_each, texts_each)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs(doc_id, text)``.

    ``lang_pred`` is ``und`` with score 0 for a text that is null or has no letter; else the score compares the
    winner's bits over up to 64 letters with those of the others (1: no doubt, 1/n: n languages fit alike).  Of
    languages that tie the first in order of text wins.  Rows are judged one by one, so repeated ids, null ids
    and empty tables need no care; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few megabytes a language, by the bound on its letters

    def run(batches):
        for batch in batches:
            language, score = sent.value.predict(batch.column(1).to_pylist()) if len(batch) else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def registered(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, by references from the folds that may be learnt from."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
