"""Toxicity scores after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents (its size is bounded
   by the alphabet: a-z, one class for other letters, word ends).
2. Labels give each word and word beginning the share of toxic documents among
   those that hold it. They are learned from at most ``TRAIN_ROWS`` labelled
   documents, those with the smallest hash of their id (all, if there are fewer).
3. Words that look disguised (leetspeak, letters set apart by spaces or signs,
   repeated letters) become a lattice of what each character may stand for;
   Viterbi decoding finds the likeliest text under the character model, with a
   prior for words that training found toxic. As that prior counts only where a
   word ends, states hold the beginnings of those words; no reading is lost. Time
   follows a word's length, memory what its readings do not share.
4. The restored text is scored: a logistic function of its three most telling
   words. Its few parameters are fitted on the same training documents, each
   scored without its own contribution to the counts.

Labels enter only steps 2 and 4; language, source and id are no inputs.

Edge cases: null and empty texts, and texts without words, get the score of a
text without telling words; documents without a label are scored alike; rows of
``labels`` with a null id or label teach nothing; several labels of one id: the
highest counts; without any training rows, or with one class only, every text gets the share of toxic training rows (0 if none);
repeated rows are scored each; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import (bounded_batches, buffers, cut, ragged, row_ranges, tidy)

#: Most labelled documents that the classifier is fitted on.
TRAIN_ROWS = 20_000
#: A document is called toxic from this score on.
THRESHOLD = 0.3
#: Strength of the prior share of toxic documents for each feature.
PRIOR = 10.0
#: Features must be in so many toxic training documents.
LEAST_TOXIC = 3
#: Lengths of word beginnings that are features besides whole words.
STEMS = (4, 5)
#: Features of a text: its highest word scores.
TOP = 3
#: Nodes that the decoder makes before it looks for those that are of no more use.
NODES = 4_096
#: Distinct words whose scores a task keeps.
CACHE_WORDS = 100_000
BATCH_BYTES = 2 << 20

# What characters stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
ANY_LETTER = "*#%?"
SIGNS = " ._-~,:;'\"/\\^&=*#%?"
END, OTHER = "$", "~"
#: A word that no toxic word begins like.
LOST = "~"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + END + OTHER
THRICE = re.compile(r"(.)\1\1", re.DOTALL)


def letter_class(c: str) -> str:
    return c if "a" <= c <= "z" else OTHER


def plain(word: str) -> str:
    """Without signs at both ends."""
    if word.isalnum():
        return word
    i, j = 0, len(word)
    while i < j and not word[i].isalnum():
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    return word[i:j]


def disguised(word: str) -> str | None:
    """The part of a lower-case word to decode, if it looks disguised."""
    if word.isalpha():
        return word if THRICE.search(word) else None
    core = plain(word)
    start = word.find(core) if core else 0
    # a lone leet sign in front belongs to the word
    if start and word[start - 1] in LEET and (start < 2 or word[start - 2] != word[start - 1]):
        core = word[start - 1] + core
    if not any(c.isalpha() for c in core):
        return None
    odd = any(not c.isalpha() for c in core)
    return core if odd or THRICE.search(core) else None


class Decoder:
    """Viterbi decoding of character lattices."""

    def __init__(self, trigrams: dict[str, int], toxic_words: set[str]):
        self.three = trigrams
        self.two: Counter = Counter()
        for gram, n in trigrams.items():
            self.two[gram[:2]] += n
        self.toxic_words = toxic_words
        self.begun = {w[:n] for w in toxic_words for n in range(1, len(w) + 1)}

    def cost(self, before: str, c: str) -> float:
        """Minus log of the probability of a letter class after two others."""
        return -math.log((self.three.get(before + c, 0) + 0.1) / (self.two.get(before, 0) + 2.8))

    def options(self, text: str, i: int) -> list[tuple[str, float]]:
        """What a character may stand for: (letter, cost); "" leaves it out and
        END ends the word."""
        c = text[i]
        if c.isalpha():
            return [(c, 0.0)]
        out = [(x, 1.0) for x in LEET.get(c, "")]
        inner = 0 < i < len(text) - 1
        if c in SIGNS or not out:
            out += [("", 0.5), (END, 1.0)]
        if c in ANY_LETTER and inner:
            out += [(x, 2.0) for x in "abcdefghijklmnopqrstuvwxyz"]
        return out

    def restore(self, text: str) -> list[str]:
        """The words of the likeliest reading."""
        return self.decode(text)[1].split()

    def decode(self, text: str) -> tuple[float, str]:
        """Cost and text of the likeliest reading; of equal costs the one that begins smallest.
        All that later costs depend on is a state's key: the last two letter classes,
        the word so far (``LOST`` where no toxic word begins so) and the last letter.
        A state is (cost, node of the letters before the last one)."""
        done = Readings()
        states = {(END + END, "", ""): (0.0, -1)}
        for i in range(len(text)):
            following: dict[tuple[str, str, str], tuple[float, int]] = {}
            choices = self.options(text, i)

            def reach(key, cost, parent, following=following):
                held = following.get(key)
                if held is None or cost < held[0] or (cost == held[0] and parent != held[1]
                                                      and done.compare(parent, held[1]) < 0):
                    following[key] = cost, parent

            for key, (cost, parent) in states.items():
                before, word, last = key
                node = done.node(parent, last)
                for c, extra in choices:
                    if c == "" or c == END and last in ("", " "):
                        reach(key, cost + extra, parent)
                    elif c == END:
                        reach((END + END, "", " "), cost + extra + self.ended(before, word), node)
                    else:
                        if c == last:  # a repeated letter may count once
                            reach(key, cost + 1.0, parent)
                        k = letter_class(c)
                        reach((before[1] + k, word + c if word + c in self.begun else LOST, c),
                              cost + extra + self.cost(before, k), node)
            states = following
            if len(done.letter) >= done.enough:
                states = done.shrink(states)
        least = min(cost + self.ended(key[0], key[1]) for key, (cost, _) in states.items())
        return least, min(done.text(parent, key[2]) for key, (cost, parent) in states.items()
                          if cost + self.ended(key[0], key[1]) == least)

    def ended(self, before: str, word: str) -> float:
        if not word:
            return 0.0
        # a toxic word is likelier than the model of all words has it
        return min(self.cost(before, END), 5.0) - (4.0 + len(word) if word in self.toxic_words else 0.0)


class Readings:
    """The letters of decoding paths as a tree, one node for each distinct beginning,
    so that a step costs the same at every length. What all paths share is written
    out and their dead ends go as the tree grows."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.letter: list[str] = []
        self.depth: list[int] = []
        self.known: dict[tuple[int, str], int] = {}
        self.settled: list[str] = []
        self.enough = NODES

    def node(self, parent: int, letter: str) -> int:
        at = self.known.get((parent, letter))
        if at is None:
            at = self.known[parent, letter] = len(self.letter)
            self.parent.append(parent)
            self.letter.append(letter)
            self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        return at

    def compare(self, p: int, q: int) -> int:
        """Order of the texts at two nodes, from where they part."""
        m, n = (self.depth[k] if k >= 0 else -1 for k in (p, q))
        x = y = ""
        for _ in range(m - n):
            p, x = self.parent[p], self.letter[p]
        for _ in range(n - m):
            q, y = self.parent[q], self.letter[q]
        while p != q:
            p, x, q, y = self.parent[p], self.letter[p], self.parent[q], self.letter[q]
        return (x > y) - (x < y)

    def text(self, parent: int, letter: str) -> str:
        out = [letter]
        while parent >= 0:
            out.append(self.letter[parent])
            parent = self.parent[parent]
        return "".join(self.settled) + "".join(reversed(out))

    def shrink(self, states: dict) -> dict:
        """The states, on a tree with only what they need."""
        ends = {parent for _, parent in states.values()}
        needed = set()
        for at in ends:
            while at >= 0 and at not in needed:
                needed.add(at)
                at = self.parent[at]
        kept = sorted(needed)
        children = Counter(self.parent[at] for at in kept)
        top = 0  # parents come before their children: the shared beginning is a run of single children
        if -1 not in ends:
            while kept[top] not in ends and children[kept[top]] == 1:
                top += 1
        self.settled.append("".join(self.letter[at] for at in kept[:top]))
        kept = kept[top:]
        new = {at: k for k, at in enumerate(kept)}
        self.parent = [new.get(self.parent[at], -1) for at in kept]
        self.letter = [self.letter[at] for at in kept]
        self.depth = [self.depth[at] for at in kept]
        self.known = {(p, c): k for k, (p, c) in enumerate(zip(self.parent, self.letter, strict=True))}
        self.enough = 2 * len(kept) + NODES
        return {key: (cost, new.get(parent, -1)) for key, (cost, parent) in states.items()}


class TextWords:
    """The words of some texts: distinct ones, and which are in which text."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        lists = pc.utf8_split_whitespace(low)
        at = np.asarray(lists.offsets).astype(np.int64)
        coded = lists.values.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.which = np.asarray(coded.indices).astype(np.int64)[:]
        self.at = at - at[0]
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(at))

    def spaced(self) -> list[tuple[int, str]]:
        """(text, letters with spaces) of runs of three or more single characters."""
        single = np.array([len(w) == 1 and (w.isalnum() or w in LEET) for w in self.words], bool)
        if not len(single) or not single.any():
            return []
        on = single[self.which]
        first = on.copy()
        first[1:] &= ~on[:-1] | (self.row[1:] != self.row[:-1])
        starts = np.flatnonzero(first)
        run = np.cumsum(first)[on]
        length = np.bincount(run - 1, minlength=len(starts))
        return [(int(self.row[s]), " ".join(self.words[k] for k in self.which[s:s + n].tolist()))
                for s, n in zip(starts.tolist(), length.tolist(), strict=True) if n >= 3]


def simple_words(word: str) -> list[str]:
    """The words of a token that isn't decoded."""
    core = plain(word)
    return [core] if core else []


def features(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word] + [f"{word[:k]}-" for k in STEMS if len(word) > k]


def _parts(it):
    for batch in it:
        at, _ = buffers(batch.column("text"))
        for lo, hi in row_ranges(at, BATCH_BYTES):
            yield batch.slice(lo, hi - lo)


def _count_letters(it):
    """Trigrams of letter classes over all words, one table of bounded size a task."""
    size = len(LETTERS)
    table = np.zeros(size ** 3, np.int64)
    for part in _parts(it):
        words = TextWords(part.column("text"))
        count = np.bincount(words.which, minlength=len(words.words))
        cores = [plain(w) for w in words.words]
        on = np.array([c.isalpha() for c in cores], bool)
        cores = [c for c in cores if c.isalpha()]
        points = np.frombuffer("".join(f"{END}{END}{c}{END}" for c in cores).encode("utf-32-le"), np.uint32)
        code = np.where((points >= ord("a")) & (points <= ord("z")), points - ord("a"),
                        np.where(points == ord(END), LETTERS.index(END), LETTERS.index(OTHER))).astype(np.int64)
        length = np.array([len(c) for c in cores], np.int64)
        at = ragged(np.cumsum(length + 3) - (length + 3), length + 1)
        gram = (code[at] * size + code[at + 1]) * size + code[at + 2]
        table += np.bincount(gram, np.repeat(count[on], length + 1), len(table)).astype(np.int64)
    found = np.flatnonzero(table)
    yield pa.RecordBatch.from_pydict({
        "gram": pa.array([LETTERS[g // size ** 2] + LETTERS[g // size % size] + LETTERS[g % size]
                          for g in found.tolist()], pa.string()),
        "n": pa.array(table[found])})


def _count_features(it):
    for part in _parts(it):
        words = TextWords(part.column("text"))
        have: tuple[Counter, Counter] = (Counter(), Counter())
        own = [[f for w in simple_words(token) for f in features(w)] for token in words.words]
        for i, label in enumerate(part.column("toxic").to_pylist()):
            held = set(words.which[words.at[i]:words.at[i + 1]].tolist())
            have[label].update(set().union(*(own[k] for k in held)))
        keys = list(have[0] | have[1])
        yield pa.RecordBatch.from_pydict({"feature": pa.array(keys, pa.string()),
                                          "clean": pa.array([have[0][k] for k in keys], pa.int64()),
                                          "toxic": pa.array([have[1][k] for k in keys], pa.int64())})


class Model:
    """Counts of features in clean and toxic documents, and the logistic function."""

    def __init__(self, counts: dict[str, tuple[int, int]], clean: int, toxic: int, trigrams: dict[str, int]):
        self.counts, self.rows = counts, (clean, toxic)
        self.share = toxic / max(1, clean + toxic)
        self.base = math.log((self.share + 1e-6) / (1 - self.share + 1e-6))
        self.weights = np.array([self.base, *[0.0] * TOP])
        telling = {w for w, (a, b) in counts.items() if not w.endswith("-") and self.odds(a, b) >= 2.0}
        self.decoder = Decoder(trigrams, telling)
        self.scores = {f: self.odds(a, b) for f, (a, b) in counts.items()}
        self.cache: dict[str, float] = {}

    def odds(self, clean: int, toxic: int) -> float:
        p = (toxic + PRIOR * self.share) / (clean + toxic + PRIOR)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return max(0.0, math.log(p / (1 - p)) - self.base)

    def words_of(self, token: str) -> list[str]:
        """The words of a token, with those of its likeliest reading if it looks disguised."""
        words = simple_words(token)
        if (odd := disguised(token)) is not None:
            words = words + self.decoder.restore(odd)
        return words

    def best(self, words: list[str], label: int | None = None) -> float:
        """The highest odds of the words' features, for a training document
        without its own contribution."""
        found = [f for w in words for f in features(w) if f in self.scores]
        if not found:
            return 0.0
        if label is None:
            return max(self.scores[f] for f in found)
        return max(self.odds(self.counts[f][0] - (label == 0), self.counts[f][1] - (label == 1)) for f in found)

    def describe(self, texts: pa.Array, labels: list[int] | None = None) -> np.ndarray:
        """The highest scores among the distinct words of each text, ``TOP`` of them."""
        words = TextWords(texts)
        n = len(texts)
        if labels is None:
            if len(self.cache) > CACHE_WORDS:
                self.cache = {}
            known = self.cache
            score = np.empty(len(words.words))
            for i, w in enumerate(words.words):
                s = known.get(w)
                if s is None:
                    s = known[w] = self.best(self.words_of(w))
                score[i] = s
            value = score[words.which]
        else:
            read = [self.words_of(w) for w in words.words]
            both = [np.array([self.best(r, y) for r in read]) for y in (0, 1)]
            value = np.where(np.array(labels)[words.row] == 1, both[1][words.which], both[0][words.which]) \
                if len(words.which) else np.zeros(0)
        row, which = words.row, words.which
        on = value > 0
        row, which, value = row[on], which[on], value[on]
        extra = [(r, self.best(self.decoder.restore(s), labels[r] if labels else None), -1 - k)
                 for k, (r, s) in enumerate(words.spaced())]
        if extra:
            row = np.concatenate((row, [e[0] for e in extra]))
            value = np.concatenate((value, [e[1] for e in extra]))
            which = np.concatenate((which, [e[2] for e in extra]))
        # each distinct word once
        order = np.lexsort((which, row))
        row, which, value = row[order], which[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (which[1:] != which[:-1])
        row, value = row[new], value[new]
        order = np.lexsort((-value, row))
        row, value = row[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        out = np.zeros((n, TOP))
        top = place < TOP
        out[row[top], place[top]] = value[top]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method, with a small ridge."""
        if not len(y) or y.min() == y.max():
            self.weights = np.array([-30.0 if self.share == 0 else 30.0 if self.share == 1 else self.base,
                                     *[0.0] * TOP])
            return
        design = np.hstack((np.ones((len(y), 1)), x))
        ridge = np.diag([1e-6, *[0.05] * TOP])
        w = np.zeros(TOP + 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-design @ w))
            gradient = design.T @ (y - p) - ridge @ w
            step = np.linalg.solve((design.T * (p * (1 - p))) @ design + ridge + 1e-9 * np.eye(TOP + 1), gradient)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -60, 60)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", corpus: DataFrame | None = None, rows: int = TRAIN_ROWS) -> Model:
    """Fit the model. ``corpus`` (default: ``docs``) is what the character model
    is counted over."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    whole = src if corpus is None else corpus.select(F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
             .filter(F.col("id").isNotNull() & F.col("toxic").isin(0, 1)))
    chosen = (known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(rows))
    # at most `rows` ids: their texts are found without shuffling the documents
    taught = cut(src.join(F.broadcast(chosen), "id").select("text", "toxic"))
    trigrams = {r[0]: r[1] for r in
                whole.select("text").mapInArrow(tidy(_count_letters), "gram string, n long")
                .groupBy("gram").agg(F.sum("n")).toLocalIterator()}
    sizes = {r[0]: r[1] for r in taught.groupBy("toxic").count().collect()}
    found = (taught.mapInArrow(tidy(_count_features), "feature string, clean long, toxic long")
             .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
             .filter(F.col("toxic") >= LEAST_TOXIC)
             .filter(F.col("toxic") * sum(sizes.values())
                     > (F.col("clean") + F.col("toxic")) * sizes.get(1, 0)).toArrow())
    counts = dict(zip(found["feature"].to_pylist(),
                      zip(found["clean"].to_pylist(), found["toxic"].to_pylist(), strict=True), strict=True))
    model = Model(counts, sizes.get(0, 0), sizes.get(1, 0), trigrams)
    shared = spark.sparkContext.broadcast(model)

    def describe(it):
        own = shared.value
        for part in _parts(it):
            y = part.column("toxic").to_pylist()
            x = own.describe(part.column("text"), y)
            yield pa.RecordBatch.from_pydict(
                {"y": pa.array(y, pa.int32())} | {f"x{i}": pa.array(x[:, i], pa.float64()) for i in range(TOP)})

    fields = ", ".join(f"x{i} double" for i in range(TOP))
    data = taught.mapInArrow(tidy(describe), f"y int, {fields}").toArrow()
    x = np.stack([np.asarray(data[f"x{i}"]) for i in range(TOP)], 1) if len(data) else np.zeros((0, TOP))
    model.fit(x, np.asarray(data["y"]))
    return model


def score_of(text: Column, model: Model, spark) -> Column:
    """The score of each text, by an Arrow function over the text alone."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            at, _ = buffers(texts)
            out = [own.score(own.describe(texts.slice(lo, hi - lo))) for lo, hi in row_ranges(at, BATCH_BYTES)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        own.cache = {}  # the model stays with the worker; what it has cached needn't

    freeing = tidy(score)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from freeing(batches)

    return F.arrow_udf(run, "double")(text.cast("string"))
