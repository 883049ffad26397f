"""Toxicity scores: a learned lexicon, Levenshtein automata over its trie, and context windows.

Training uses at most SAMPLE labelled documents (a documented bound; chosen by a hash of the id). Terms that are far more usual in
toxic documents form the lexicon. Its trie is intersected with the Levenshtein automata of its terms into one table-driven
automaton, which all words of a block of texts run through in step. A hit whose context window holds quotation marks on both
sides counts as quoted. A logistic regression on these counts gives the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.llm.common import id_and_text, lower_ascii, materialize, releasing, text_blocks, word_bounds

SAMPLE = 20_000
#: A term's odds are this much higher in toxic texts, at least so many of which hold it in passages of their own; and by chance a term
#: would be in as many toxic ones of its texts with a probability of exp(-SURE) at most.
LEAST_LOG_ODDS, LEAST_TEXTS, SURE = 2.0, 5, 9.2
THRESHOLD = 0.7
#: Words to either side of a hit that are searched for quotation marks.
WINDOW = 5
FEATURES = ("any_plain", "plain", "fuzzy", "quoted", "density")

_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: Lengths in characters of the stems that are counted beside whole words; a stem is written with this sign behind it.
STEM_CHARS, STEM = (4, 5, 6, 7), "*"
#: Terms with edits that share an automaton.
EDIT_TERMS = 40
#: Words to either side of a term that tell a passage from another.
PASSAGE = 2


def edits_allowed(term: str) -> int:
    """None for a stem, which already stands for many words."""
    return 0 if len(term) < 5 or term.endswith(STEM) else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """A deterministic automaton for all words within the allowed edits of a term, or that begin with a stem."""

    def __init__(self, terms: list[str], most_states: int = 60_000) -> None:
        self.terms = terms
        words = [t.removesuffix(STEM).encode() for t in terms]
        used = sorted({b for w in words for b in w})
        self.classes = np.zeros(256, np.int32)
        for i, b in enumerate(used, 1):
            self.classes[b] = i
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        stems: list[int] = [-1]
        for t, w in enumerate(words):
            node = 0
            for b in w:
                c = int(self.classes[b])
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    stems.append(-1)
                node = children[node][c]
            (stems if terms[t].endswith(STEM) else ends)[node] = t
        budget = [0] * len(children)
        for node in range(len(children) - 1, -1, -1):  # children have larger numbers
            own = edits_allowed(terms[ends[node]]) if ends[node] >= 0 else 0
            budget[node] = max([own, *(budget[x] for x in children[node].values())])

        def closed(pairs: dict[int, int]) -> frozenset:
            # a stem that was reached unchanged stays reached, as the node -1 - term
            pairs |= {-1 - stems[n]: 0 for n, e in list(pairs.items()) if n > 0 and e == 0 and stems[n] >= 0}
            todo = list(pairs.items())
            while todo:  # dropping a letter of the term
                node, e = todo.pop()
                for x in children[node].values() if node >= 0 else ():
                    if e + 1 <= budget[x] and pairs.get(x, 99) > e + 1:
                        pairs[x] = e + 1
                        todo.append((x, e + 1))
            return frozenset(pairs.items())

        start = closed({0: 0})
        number, states, table = {frozenset(): 0, start: 1}, [frozenset(), start], []
        done = 0
        while done < len(states):
            row = []
            for c in range(len(used) + 1):
                after: dict[int, int] = {}
                for node, e in states[done]:
                    if node < 0:
                        after[node] = e
                        continue
                    for ch, x in children[node].items():
                        cost = e + (ch != c)
                        if cost <= budget[x] and after.get(x, 99) > cost:
                            after[x] = cost
                    if e + 1 <= budget[node] and after.get(node, 99) > e + 1:
                        after[node] = e + 1
                s = closed(after)
                if s not in number:
                    if len(states) >= most_states:
                        raise ValueError("too many states for this lexicon")
                    number[s] = len(states)
                    states.append(s)
                row.append(number[s])
            table.append(row)
            done += 1
        self.table = np.array(table, np.int32)
        # of each state: the term reached with the fewest edits, and the edits
        self.term, self.edits = np.full(len(states), -1, np.int32), np.full(len(states), 9, np.int32)
        for s, pairs in enumerate(states):
            hits = [(e, ends[n]) for n, e in pairs if n >= 0 and ends[n] >= 0 and e <= edits_allowed(terms[ends[n]])]
            best = min(hits + [(e, -1 - n) for n, e in pairs if n < 0], default=None)
            if best:
                self.edits[s], self.term[s] = best
        self.longest = 1 << 30 if any(t.endswith(STEM) for t in terms) else max((len(w) for w in words), default=0) + 2
        self.shortest = min((len(w) - edits_allowed(t) for w, t in zip(words, terms)), default=1)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that match: index, term, edits."""
        none = np.zeros(0, np.int64)
        if not self.terms:
            return none, none, none
        length = ends - starts
        live = np.flatnonzero((length >= self.shortest) & (length <= self.longest))
        at, left = starts[live], length[live]
        state = np.ones(len(live), np.int32)
        classes = self.classes[data]
        found = []
        while len(live):
            state = self.table[state, classes[at]]
            at = at + 1
            left = left - 1
            over = (left == 0) & (self.term[state] >= 0)
            if over.any():
                found.append((live[over], self.term[state[over]], self.edits[state[over]]))
            go = (state > 0) & (left > 0)
            live, state, at, left = live[go], state[go], at[go], left[go]
        if not found:
            return none, none, none
        w, t, e = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(w)
        return w[order], t[order], e[order]


class LexiconAutomata:
    """Automata of parts of a lexicon, run one after another: terms with edits in parts of bounded size, all others in one."""

    def __init__(self, terms: list[str], part: int = EDIT_TERMS) -> None:
        self.parts: list[tuple[LexiconAutomaton, np.ndarray]] = []
        fuzzy = sorted((t for t in range(len(terms)) if edits_allowed(terms[t])), key=lambda t: terms[t])
        todo = [[t for t in range(len(terms)) if not edits_allowed(terms[t])], *(fuzzy[i : i + part] for i in range(0, len(fuzzy), part))]
        while todo:
            some = todo.pop()
            try:
                if some:
                    self.parts.append((LexiconAutomaton([terms[t] for t in some]), np.array(some)))
            except ValueError:  # too many states
                if len(some) == 1:
                    raise
                todo += [some[: len(some) // 2], some[len(some) // 2 :]]

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that match: index, term, edits. Of several terms that of the fewest edits, whole words before stems."""
        found = [(w, of[t], e, np.full(len(w), i)) for i, (a, of) in enumerate(self.parts) for w, t, e in [a.run(data, starts, ends)]]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        w, t, e, i = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((t, i, e, w))
        first = order[np.diff(w[order], prepend=-1) > 0]
        return w[first], t[first], e[first]


def quote_marks(data: np.ndarray) -> np.ndarray:
    """Running count of quotation marks: straight and curly double quotes, guillemets."""
    mark = data == 0x22
    if len(data) >= 3:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        mark[:-1] |= two
        mark[:-2] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F)
    return np.concatenate([[0], np.cumsum(mark)])


def features(column: pa.Array, automaton: LexiconAutomaton | LexiconAutomata, weights: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, data, offsets in text_blocks(column):
        low = lower_ascii(data)
        starts, ends, at = word_bounds(low, offsets, _NOT_WORD)
        w, term, edits = automaton.run(low, starts, ends)
        if not len(w):
            continue
        doc = np.searchsorted(at, w, "right") - 1
        marks = quote_marks(data)
        left = starts[np.maximum(w - WINDOW, at[doc])]
        right = ends[np.minimum(w + WINDOW, at[doc + 1] - 1)]
        quoted = (marks[starts[w]] > marks[left]) & (marks[right] > marks[ends[w]])
        # the marks next to a document's first or last word are outside its words
        n = np.diff(at)
        rows = out[first : first + len(offsets) - 1]
        plain = (edits == 0) & ~quoted
        np.add.at(rows[:, 1], doc[plain], weights[term[plain]])
        np.add.at(rows[:, 2], doc[(edits > 0) & ~quoted], weights[term[(edits > 0) & ~quoted]] / (1 + edits[(edits > 0) & ~quoted]))
        np.add.at(rows[:, 3], doc[quoted], weights[term[quoted]])
        rows[:, 0] = rows[:, 1] > 0
        rows[:, 4] = (rows[:, 1] + rows[:, 2]) / np.maximum(n, 1)
    out[:, 1:4] = np.log1p(out[:, 1:4])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients with the intercept last, by Newton's method with a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    ridge = np.full(len(b), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


class ToxicityModel:
    def __init__(self, terms: list[str], weights: list[float], coefficients: np.ndarray) -> None:
        self.terms, self.weights, self.coefficients = terms, np.asarray(weights, float), coefficients
        self._automaton = None

    @property
    def automaton(self) -> LexiconAutomata:
        if self._automaton is None:
            self._automaton = LexiconAutomata(self.terms)
        return self._automaton

    def scores(self, column: pa.Array) -> np.ndarray:
        x = features(column, self.automaton, self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[:-1] + self.coefficients[-1], -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = {w for w in _words(text) if 3 <= len(w.encode()) <= 60}
            stems = {w[:k] + STEM for w in words for k in STEM_CHARS if len(w) > k}
            (pos if toxic else neg).update(words | stems)
        for n in range(0, len(words := list({**pos, **neg})), 50_000):
            part = words[n : n + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pos[w] for w in part], pa.int64()), pa.array([neg[w] for w in part], pa.int64())], ["word", "pos", "neg"])


def _words(text: str) -> list[str]:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return [w.decode("utf-8", "ignore") for w in np.where(_NOT_WORD[raw], 32, lower_ascii(raw)).astype(np.uint8).tobytes().split()]


def _passages(terms: frozenset[str]):
    """Of each text, the terms in it, each with the least hash of the words around it: texts that share a passage share that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, passage = [], []
            for text in batch.column(0).to_pylist():
                words, least = _words(text), {}
                for i, w in enumerate(words):
                    mine = [t for t in (w, *(w[:k] + STEM for k in STEM_CHARS if len(w) > k)) if t in terms]
                    if mine:
                        around = " ".join(words[max(0, i - PASSAGE) : i]) + "|" + " ".join(words[i + 1 : i + 1 + PASSAGE])
                        h = zlib.crc32(around.encode("utf-8", "surrogatepass")) << 32 | zlib.adler32(around.encode("utf-8", "surrogatepass"))
                        for t in mine:
                            least[t] = min(h, least.get(t, h))
                term += least
                passage += least.values()
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array([h - (1 << 63) for h in passage], pa.int64())], ["word", "passage"])

    return run


def sure(pos: int, neg: int, n_pos: int, n_neg: int) -> bool:
    """Whether a term's own counts admit it: its odds, and Chernoff's bound of the binomial tail."""
    odds = math.log((pos + 0.5) / (n_pos + 1.0)) - math.log((neg + 0.5) / (n_neg + 1.0))
    p, n = n_pos / (n_pos + n_neg), pos + neg
    bound = sum(k * math.log(k / (n * q)) for k, q in ((pos, p), (neg, 1 - p)) if k)
    return odds >= LEAST_LOG_ODDS and bound >= SURE


@releasing
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labelled rows of docs that aren't held out. Without such rows, or of one class only, scores are constant.

    Labels that are null don't count; of repeated labels of a document the largest holds; equal texts count once.
    """
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(f"`{id_col}`").cast("long").alias("doc_id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # bounded by sample
    rows = id_and_text(docs, id_col, text_col).join(chosen, "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    rows = materialize(rows.withColumn("digest", F.md5("text")))
    rows = materialize(rows.dropDuplicates(["digest"]).drop("digest"))
    totals = rows.agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg")).first()
    n_pos, n_neg = totals["pos"], totals["neg"]
    if not n_pos or not n_neg:
        return ToxicityModel([], [], np.array([0.0] * len(FEATURES) + [4.0 if n_pos else -4.0]))
    odds = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    counts = rows.select("text", "toxic").mapInArrow(_term_counts, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    least = min(LEAST_TEXTS, max(2, math.ceil(n_pos / 10)))
    # what the sample's own words are is bounded by the sample
    terms = [t for t in counts.where((F.col("pos") >= least) & (odds >= LEAST_LOG_ODDS)).select("word", odds.alias("odds"), "pos", "neg").collect() if sure(t["pos"], t["neg"], n_pos, n_neg)]
    apart = rows.where("toxic").select("text").mapInArrow(_passages(frozenset(t["word"] for t in terms)), "word string, passage long")
    apart = dict(apart.groupBy("word").agg(F.count_distinct("passage")).collect())
    terms = [t for t in terms if (n := apart.get(t["word"], 0)) >= least and sure(min(n, t["pos"]), t["neg"], n_pos, n_neg)]
    candidates = sorted(((t["word"], t["odds"], t["pos"]) for t in terms), key=lambda c: c[0])
    terms = choose_terms(candidates, least)
    terms += words_of_stems(candidates, terms)
    model = ToxicityModel([t for t, _ in terms], [w for _, w in terms], np.zeros(len(FEATURES) + 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), model.automaton, model.weights)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], [*FEATURES, "toxic"])

    measured = rows.select("text", "toxic").mapInArrow(measure, ", ".join(f"{f} double" for f in FEATURES) + ", toxic boolean").toPandas()  # sample rows at most
    x = measured[list(FEATURES)].to_numpy()
    order = np.lexsort(x.T)
    model.coefficients = fit_logistic(x[order], measured["toxic"].to_numpy(float)[order])
    return model


def choose_terms(candidates: list[tuple[str, float, int]], least: int = LEAST_TEXTS) -> list[tuple[str, float]]:
    """Terms and stems that stand out by themselves, from the best one on: all of them, if in `least` texts.

    What begins with a chosen stem adds nothing; a stem is left out where a chosen term nearly accounts for it.
    """
    chosen: list[tuple[str, float]] = []
    stems: set[str] = set()
    usual: dict[str, int] = {}  # of each beginning, the texts of the most frequent chosen term that has it
    # of equal ones whole words come first, then long stems
    for term, odds, n in sorted(candidates, key=lambda c: (-round(c[1] * math.log1p(c[2]), 9), c[0].endswith(STEM), -len(c[0]), c[0])):
        base = term.removesuffix(STEM)
        covered = any(base[:k] in stems for k in STEM_CHARS)
        explained = term.endswith(STEM) and n <= 1.2 * usual.get(base, 0)
        if n >= least and not covered and not explained:
            chosen.append((term, odds))
            if term.endswith(STEM):
                stems.add(base)
            for k in STEM_CHARS:
                usual[base[:k]] = max(n, usual.get(base[:k], 0))
    return chosen


def words_of_stems(candidates: list[tuple[str, float, int]], chosen: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Whole words that a chosen stem stands for and that allow edits: the stem itself allows none."""
    stems = {t[:-1] for t, _ in chosen if t.endswith(STEM)}
    taken = {t for t, _ in chosen}
    return [(t, w) for t, w, _ in candidates if t not in taken and edits_allowed(t) and any(t[:k] in stems for k in STEM_CHARS)]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: ToxicityModel | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score reads the whole text and nothing else. Null and empty texts score what a text without hits scores; a null id is not
    held out; repeated rows get equal results; an empty table gives no rows.
    """
    model = model or train(docs, labels, id_col, text_col)
    model.automaton  # noqa: B018  built once, here

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more."""
    model = train(docs, labels, id_col, text_col)
    model.automaton  # noqa: B018

    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                yield part.filter(pa.array(model.scores(part.column(at)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
