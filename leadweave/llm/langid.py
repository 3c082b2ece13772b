"""Language of a text by cross-parsing against labelled text.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is parsed into the longest
phrases that occur in the sample; phrases * log2(sample size) / length estimates the cross entropy, and the language with
the least wins. Automata are dense transition tables, and all segments of a batch take a step at once, so the parse is a
few array operations per character. A parse starts anew every SEGMENT characters; every character of a text is parsed.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadweave.llm.samples import smallest_hashes
from leadweave.llm.words import slices

#: labelled rows taken per language (those with the smallest hash of their id), and characters of them used
DOCS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 200, 25_000
SEGMENT = 1024
UNKNOWN = "und"
#: bits a character above which a text is in none of the languages (labelled text: about 1.5 to 3)
MOST_BITS = 6.0


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states that recognise all substrings of a text; state 0 is the start."""
    go, link, length, last = [{}], [-1], [0], 0
    for c in text:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = now
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[now] = link[q] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
        last = now
    return go


@functools.cache
def _letters() -> np.ndarray:
    """1 for letters, 0 for all else, by code point."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)


def _plain(text: str | None) -> np.ndarray:
    """Code points in lower case, each run of anything but letters as one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points] == 1, points, 32)
    return points[(points != 32) | np.concatenate([[True], points[:-1] != 32])] if len(points) else points


@dataclass
class LanguageModel:
    """Automata of all languages in one table: next state of state * width + code, 0 for none."""

    languages: list[str]
    table: np.ndarray
    roots: np.ndarray
    width: int
    points: np.ndarray  # known code points, sorted; their codes count from 2, 0 is a blank, 1 any other letter
    weights: np.ndarray  # log2 of the sample sizes

    @classmethod
    def of(cls, samples: dict[str, str]) -> LanguageModel:
        texts = {lang: _plain(t) for lang, t in sorted(samples.items())}
        texts = {lang: t for lang, t in texts.items() if (t != 32).any()}
        points = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]))
        points = points[points != 32]
        model = cls(list(texts), np.zeros(0, np.int32), np.zeros(len(texts), np.int64), len(points) + 2, points,
                    np.array([np.log2(max(2, len(t))) for t in texts.values()]))
        parts, base = [np.zeros((1, model.width), np.int32)], 1
        for k, t in enumerate(texts.values()):
            go = suffix_automaton(model.codes(t).tolist())
            part = np.zeros((len(go), model.width), np.int32)
            for state, out in enumerate(go):
                if out:
                    part[state, list(out)] = [base + v for v in out.values()]
            model.roots[k] = base
            base += len(go)
            parts.append(part)
        model.table = np.concatenate(parts).ravel()
        return model

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        known = self.points[at] == points if len(self.points) else np.zeros(len(points), bool)
        return np.where(points == 32, 0, np.where(known, at + 2, 1)).astype(np.uint8 if self.width < 256 else np.int32)

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character, by text and language; and each text's number of letters."""
        plain = [_plain(t) for t in texts]
        size = np.array([len(p) for p in plain], np.int64)
        letters = np.array([(p != 32).sum() for p in plain], np.int64)
        codes = self.codes(np.concatenate([*plain, np.zeros(0, np.uint32)]).astype(np.uint32))
        pieces = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(size) - size)[text] + nth * SEGMENT
        length = np.minimum(size[text] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        roots = self.roots[:, None]
        state = np.repeat(roots, len(text), 1)
        phrases = np.zeros((len(roots), len(text)), np.int32)
        active = len(text)
        for step in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= step:
                active -= 1
            c = codes[begin[:active] + step].astype(np.int64)
            now = state[:, :active]
            to = self.table[now * self.width + c]
            none = to == 0
            # a phrase begins at the start of a segment, after an unknown character, and where the last one can't go on
            phrases[:, :active] += none | (now == roots)
            again = self.table[roots * self.width + c]
            state[:, :active] = np.where(none, np.where(again == 0, roots, again), to)
        total = np.zeros((len(texts), len(roots)))
        np.add.at(total, text, phrases.T)
        return total * self.weights / np.maximum(size, 1)[:, None], letters


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> LanguageModel:
    """Learn from at most DOCS_PER_LANGUAGE rows and CHARS_PER_LANGUAGE characters of each language; rows without either have no part."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where("lang is not null and length(text) > 0")
    rows = smallest_hashes(rows, "lang", "key", DOCS_PER_LANGUAGE)
    samples: dict[str, str] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["n"], r["text"])):
        have = samples.get(r["lang"], "")
        samples[r["lang"]] = (have + " " + r["text"])[:CHARS_PER_LANGUAGE] if len(have) < CHARS_PER_LANGUAGE else have
    return LanguageModel.of(samples)


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, bits.

    bits: of the language that wins, per character. score: the runner-up's share of both, 0.5 for a tie (the language
    first by name wins), 1 if there is one language only. A text that is null or has no letter, and every text if nothing
    was learned, is ``und`` with score 0 and null bits. Ids may be null or repeated. Columns named in ``carry`` come along as a
    struct ``carried``, with the text itself as ``text``; others are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in slices(batches, "text", 2 << 20):
            texts = batch.column(1).to_pylist()
            names, scores, best = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            if model.languages:
                bits, letters = model.bits(texts)
                order = np.argsort(bits, 1, kind="stable")
                for k in np.flatnonzero(letters):
                    a = bits[k, order[k, 0]]
                    names[k], best[k] = model.languages[order[k, 0]], float(a)
                    scores[k] = float(bits[k, order[k, 1]] / (a + bits[k, order[k, 1]])) if len(model.languages) > 1 else 1.0
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns + ([batch.column(2), batch.column(1)] if carry else []),
                                             names=["id", "lang_pred", "score", "bits"] + (["carried", "text"] if carry else []))

    docs = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    types = dict(docs.dtypes)
    more = f", carried {types['carried']}, text string" if carry else ""
    return docs.mapInArrow(run, f"id {types['id']}, lang_pred string, score double, bits double{more}").withColumnRenamed("id", id_column)
