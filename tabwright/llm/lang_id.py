"""Language by cross-parsing: the language whose training text needs the fewest phrases to spell out a text.

A suffix automaton of a language's training text accepts exactly its substrings. A text is parsed from left to right into
phrases, each the longest match with that text; where no match goes on, the next phrase begins. The count of phrases,
times the bits of one phrase's place in the training text, per character, estimates the cross entropy, and the smallest
wins. The automata's transitions lie in one array, the gaps of a state's row filled by other states, and a batch's texts
are cut into segments that are parsed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import kept_rows, let_go, slices
from tabwright.llm.quality_trees import held_out

#: distinct labelled texts that are learned of each language, whole; those of more characters than `USUAL` come last
ROWS, USUAL = 40, 8_192
#: parts of a language from which the texts are first picked
SALTS = 256
#: characters of a text that are parsed in one go; a phrase ends where a segment does
SEGMENT = 512
UNKNOWN = "und"

SPACE, OTHER = 0, 1  # codes of any run of other characters, and of a letter that no training text has


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True at the code point of every letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def points(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of others than letters as one 0."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    p = np.where(letters()[p], p, 0)
    return p[(p != 0) | np.concatenate([[True], p[:-1] != 0])] if len(p) else p


class Transitions:
    """Transitions of an automaton, each state's row shifted to where all its codes fall into gaps.

    Indexed by state * alphabet + code. A missing transition gives ~s, where s is the state after the code alone, from
    which the next phrase goes on.
    """

    def __init__(self, step: list[dict[int, int]], alphabet: int):
        self.alphabet, self.shift = alphabet, np.zeros(len(step), np.int64)
        self.alone = np.zeros(alphabet, np.int32)
        self.alone[list(step[0].keys())] = list(step[0].values())
        self.alone = ~self.alone
        slots = 2 * sum(map(len, step)) + alphabet
        owner, target = [-1] * slots, [0] * slots
        gap = 0  # no gap lies before it
        for state in sorted(range(len(step)), key=lambda s: -len(step[s])):
            codes = sorted(step[state])
            if not codes:
                break
            while gap < len(owner) and owner[gap] >= 0:
                gap += 1
            at = gap
            for _ in range(50):
                if owner[at] < 0 and all(at + c - codes[0] < len(owner) and owner[at + c - codes[0]] < 0 for c in codes):
                    break
                at = at + 1 if at + 1 < len(owner) else gap
            else:
                at = len(owner)
            more = at + codes[-1] - codes[0] + 1 - len(owner)
            if more > 0:
                owner.extend([-1] * more), target.extend([0] * more)
            self.shift[state] = at - codes[0]
            for c in codes:
                owner[at + c - codes[0]], target[at + c - codes[0]] = state, step[state][c]
        # any state and code have a slot
        low, high = min(0, int(self.shift.min())), max(len(owner), int(self.shift.max()) + alphabet)
        self.shift -= low
        self.owner, self.target = np.full(high - low, -1, np.int32), np.zeros(high - low, np.int32)
        self.owner[-low:len(owner) - low], self.target[-low:len(owner) - low] = owner, target

    def go(self, state, code):
        at = self.shift[state] + code
        return np.where(self.owner[at] == state, self.target[at], self.alone[code])

    def __getitem__(self, key):
        return self.go(*divmod(key, self.alphabet))


def automaton(texts: list[np.ndarray], alphabet: int) -> Transitions:
    """The suffix automaton of several texts of codes."""
    step, link, length = [{}], [-1], [0]
    for text in texts:
        last = 0
        for c in text.tolist():
            if c in step[last]:  # the text so far is known; split its state if that holds longer texts too
                q = step[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                clone = len(step)
                step.append(dict(step[q])), link.append(link[q]), length.append(length[last] + 1)
                link[q] = clone
                p = last
                while p >= 0 and step[p].get(c) == q:
                    step[p][c], p = clone, link[p]
                last = clone
                continue
            new, p = len(step), last
            step.append({}), link.append(0), length.append(length[last] + 1)
            while p >= 0 and c not in step[p]:
                step[p][c], p = new, link[p]
            if p >= 0:
                q = step[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                    link[q] = link[new] = clone
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c], p = clone, link[p]
            last = new
    return Transitions(step, alphabet)


class Languages:
    """Automata of (language, texts), smaller names first."""

    def __init__(self, sample: tuple[tuple[str, tuple[str, ...]], ...]):
        parts = {name: [points(t) for t in texts] for name, texts in sorted(sample)}
        used = np.unique(np.concatenate([np.zeros(1, np.uint32), *[p for ps in parts.values() for p in ps]]))
        used = used[used > 0]
        self.alphabet = len(used) + 2
        self.code = np.full(0x110000, OTHER, np.int32)
        self.code[0] = SPACE
        self.code[used] = np.arange(2, self.alphabet)
        self.names = list(parts)
        self.tables = [automaton([self.code[p] for p in ps], self.alphabet) for ps in parts.values()]
        self.bits = [np.log2(sum(map(len, ps)) + 2) for ps in parts.values()]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text of codes."""
        flat = np.concatenate([*texts, np.zeros(0, np.int32)])
        owner = [(i, at, min(SEGMENT, len(t) - at)) for i, t in enumerate(texts) for at in range(0, len(t), SEGMENT)]
        out = np.zeros((len(texts), len(self.names)))
        if not owner:
            return out
        doc, at, size = np.array(owner).T
        begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])[doc] + at
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order], size[order]
        still = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # segments that have a j-th character
        codes = [flat[begin[:k] + j] for j, k in enumerate(still)]
        for lang, table in enumerate(self.tables):
            state, count = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int64)
            for c, k in zip(codes, still):
                s = table.go(state[:k], c)
                failed = s < 0
                count[:k] += failed | (state[:k] == 0)  # a phrase begins where a match ends, or nothing has matched yet
                state[:k] = np.where(failed, ~s, s)
            out[:, lang] = np.bincount(doc, count, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and by which share it needs fewer bits than the next one (1 if there is no other)."""
        coded = [self.code[points(t)] if t else np.zeros(0, np.int32) for t in texts]
        lettered = np.array([bool((c > SPACE).any()) for c in coded], bool)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cost = self.phrases(coded) * np.array(self.bits)
        best = cost.argmin(axis=1) if len(texts) else np.zeros(0, int)
        if len(self.names) > 1:
            two = np.partition(cost, 1, axis=1)[:, :2]
            score = np.where(lettered, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
        else:
            score = lettered.astype(float)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)], score

    def known(self, texts: list[str | None]) -> np.ndarray:
        """Which texts have a language; without any learned, which have a letter."""
        if not self.names:
            return np.array([any(c.isalpha() for c in t or "") for t in texts], bool)
        return np.array([n != UNKNOWN for n in self.predict(texts)[0]], bool)


@lru_cache(maxsize=1)
def built(sample: tuple) -> Languages:
    """The automata of a sample, built once in each Python worker."""
    model = Languages(sample)
    let_go()  # what building took
    return model


def learn_languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> tuple:
    """Per language, ``rows`` distinct labelled texts, whole, of those whose id's remainder by 3 is not 1.

    Every language with such a text is learned, however rare, so the sample is bounded for each language. Equal texts are
    one. Texts of at most `USUAL` characters come first, longer ones only where too few others are there; among them the
    smallest hashes are taken, first of each of `SALTS` parts of a language and then of the language.
    """
    known = (df.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
             .where("id is not null and lang is not null and text is not null").where(held_out("id", 3) != 1)
             .select("lang", (F.length("text") > USUAL).alias("long"), F.xxhash64("text").alias("key"), "text"))
    picked = known.select("lang", "long", "key").distinct().withColumn("salt", F.pmod("key", F.lit(SALTS)))
    for part in (["lang", "salt"], ["lang"]):
        picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy("long", "key"))).where(F.col("rank") <= rows)
    picked = df.sparkSession.createDataFrame([tuple(r) for r in picked.select("lang", "key", "rank").collect()], "lang string, key long, rank int")  # a sample's size
    texts = known.join(F.broadcast(picked), ["lang", "key"]).select("lang", "rank", "text")
    sample: dict[str, list[str]] = {}
    for r in texts.groupBy("lang", "rank").agg(F.min("text").alias("text")).orderBy("lang", "rank").collect():
        sample.setdefault(r.lang, []).append(r.text)
    return tuple((k, tuple(v)) for k, v in sorted(sample.items()))


def predict_language(df: DataFrame, sample: tuple, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, lang_pred, score.

    Only the text is an input, all of it. A null text or one without a letter is ``und`` with score 0; equal costs go to
    the smaller name; repeated rows are judged alike. A null doc_id stays null and counts as not held out. Other columns
    are not read; an empty table gives an empty result.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out(doc_id, 3) == 1, F.lit(False)).alias("held_out"),
                     F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = built(sample)
        for b in slices(batches, 1_000):
            names, score = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])
        let_go()

    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(df: DataFrame, sample: tuple, text: str = "text") -> DataFrame:
    """The rows of ``df`` with all their columns whose text has a language, or a letter if no language could be learned."""
    return kept_rows(df, text, lambda texts: built(sample).known(texts), 1_000)
