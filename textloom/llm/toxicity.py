"""Toxicity by a learned lexicon: Levenshtein automata intersected with the lexicon's trie find terms and their
misspellings, and a window around each hit tells abuse from quotation.

The lexicon and a logistic model over a document's hits are learned from labelled rows. Automaton and trie are walked
together as one deterministic automaton, made as far as the words need it: a state is a set of (trie node, edits).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, release, table, text_batches

TRAIN_DOCS = 12_000  #: the classifier's labelled rows: at most so many, those of least hash
COUNTED = 60_000  #: terms that a task counts at once, of each label and but for those of one text
STEM, LONGEST = 4, 9  #: letters of a beginning of words: the least, and the most; longer words are whole terms
WINDOW = 8
THRESHOLD = 0.3
STRIP = ".,;:!?\"'()[]{}<>«»“”„‘’…-_*#/\\|~`^+=&%$@"
OPEN_MARKS, CLOSE_MARKS = "“„«‘", "”»’"
LEET = str.maketrans("013457@$!", "oieastasi")  #: digits and signs in place of letters
#: Fixed list: words that report what someone else said.
REPORTS = frozenset("said says wrote writes called calling quote quoted quotes according dit écrit selon cité sagte schrieb laut zitat dijo escribió según cita".split())


@dataclass
class Term:
    text: str
    stem: bool  #: any ending may follow
    edits: int
    weight: float


@dataclass
class Lexicon:
    """The automaton of all terms. find(word) gives (term number, edits) of the best match, or None."""

    terms: list[Term]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    whole: list[int] = field(default_factory=lambda: [-1])
    stem: list[int] = field(default_factory=lambda: [-1])
    most: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for number, t in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], t.edits)
            for ch in t.text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.whole.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], t.edits)
            (self.stem if t.stem else self.whole)[node] = number
        self.reset()

    def reset(self):
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.opens: list[tuple[int, int] | None] = []
        self.start = self.state({(0, 0)})

    def state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of (node, edits), closed under letters that the word leaves out."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.children[node].values()]
        key = frozenset(best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hit = lambda of: min(((e, of[n]) for n, e in key if of[n] >= 0 and e <= self.terms[of[n]].edits), default=None)
            self.ends.append(hit(self.whole))
            self.opens.append(hit(self.stem))
        return self.numbers[key]

    def step(self, at: int, ch: str) -> int:
        if len(self.sets) > 50_000:  # made anew as the words need it
            pairs = self.sets[at]
            self.reset()
            at = self.state(set(pairs))
        out = set()
        for node, e in self.sets[at]:
            out.add((node, e + 1))
            for c, child in self.children[node].items():
                out.add((child, e if c == ch else e + 1))
        to = self.state(out)
        if len(self.steps) > at:
            self.steps[at][ch] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        at, best = self.start, None
        for ch in word:
            to = self.steps[at].get(ch)
            at = self.step(at, ch) if to is None else to
            if not self.sets[at]:
                return best and (best[1], best[0])
            o = self.opens[at]
            if o is not None and (best is None or o < best):
                best = o
        e = self.ends[at]
        if e is not None and (best is None or e <= best):
            best = e
        return best and (best[1], best[0])


class Hits(dict):
    """Word to (term number, edits) or None, remembered for `most` words."""

    def __init__(self, lexicon: Lexicon, most: int = 50_000):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(STRIP)
        found = self.lexicon.find(bare) if len(bare) >= 3 else None
        if found is None and len(bare) >= 4 and not bare.isalpha() and (plain := word.translate(LEET).strip(STRIP)).isalpha() and sum(map(str.isalpha, bare)) >= 2:
            found = self.lexicon.find(plain)
            found = found and (found[0], found[1] + 1)
        if len(word) <= 64:
            self[word] = found
        return found


def quoted(words: list[str], i: int) -> float:
    """How much the window around word i looks like quotation: 0 to 1."""
    before, after = " ".join(words[max(0, i - WINDOW) : i]), " ".join(words[i + 1 : i + 1 + WINDOW])
    own = words[i]
    opened = before.count('"') % 2 == 1 or own.startswith('"') or any(before.rfind(o) > before.rfind(c) for o, c in zip(OPEN_MARKS, "”“»’", strict=True)) or own[:1] in OPEN_MARKS
    closed = '"' in after or own.endswith('"') or any(c in after for c in CLOSE_MARKS) or own[-1:] in CLOSE_MARKS
    report = any(w.strip(STRIP) in REPORTS for w in words[max(0, i - WINDOW) : i])
    return (0.7 if opened and closed else 0.0) + (0.3 if report else 0.0)


FEATURES = 7


def features(text: str, hits: Hits) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """What the logistic model reads: abuse and quotation in all windows, the share of hits, near misses, the weightiest
    hit, how many; and the hits as (term number, edits)."""
    words = text.lower().split()
    at = [i for i, h in enumerate([hits[w] for w in words]) if h is not None]
    x = np.zeros(FEATURES)
    found = []
    abuse = quotes = near = most = 0.0
    for j, i in enumerate(at):
        number, edits = hits[words[i]]
        found.append((number, edits))
        q = quoted(words, i)
        others = sum(1 for k in at[max(0, j - WINDOW) : j + WINDOW + 1] if k != i and abs(k - i) <= WINDOW)
        weight = hits.lexicon.terms[number].weight * (0.6 if edits else 1.0)
        abuse += weight * (1 - q) * (1 + 0.25 * min(others, 4))
        quotes += weight * q
        near += bool(edits)
        most = max(most, hits.lexicon.terms[number].weight * (1 - q))
    if at:
        x[:] = math.log1p(abuse), math.log1p(quotes), math.log1p(100 * len(at) / len(words)), math.log1p(near), most, math.log1p(len(at)), 1.0
    return x, found


@dataclass
class Model:
    terms: list[Term]
    coefficients: np.ndarray
    intercept: float

    def scorer(self):
        hits = Hits(Lexicon(self.terms))
        return lambda text: float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features(text or "", hits)[0] @ self.coefficients) + self.intercept)))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def candidates(train: DataFrame) -> DataFrame:
    """(term, stem, toxic, clean, in_toxic, in_clean): in how many documents of each label a word, or a beginning of
    words, stands, and how often it stands in them."""
    names = ["term", "stem", "toxic", "clean", "in_toxic", "in_clean"]

    def flush(counts):
        for label, of in enumerate(counts):
            rows = list(of.items())
            for at in range(0, len(rows), 50_000):
                part = rows[at : at + 50_000]
                mine, zero = [pa.array([r[1][i] for r in part], pa.int64()) for i in (0, 1)], pa.array([0] * len(part), pa.int64())
                numbers = [zero, mine[0], zero, mine[1]] if label == 0 else [mine[0], zero, mine[1], zero]
                yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in part], pa.string()), pa.array([r[0][1] for r in part], pa.bool_()), *numbers], names=names)
            of.clear()

    def run(batches):
        counts: tuple[dict, dict] = ({}, {})
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                mine: Counter = Counter()
                for w, n in Counter((text or "").lower().split()).items():
                    w = w.strip(STRIP)
                    if len(w) >= 3:  # find() looks at no shorter words either
                        mine[w, False] += n
                    for k in range(STEM, min(LONGEST, len(w)) + 1):
                        mine[w[:k], True] += n
                of = counts[label]
                for key, n in mine.items():
                    c = of.get(key)
                    if c is None:
                        of[key] = [1, n]
                    else:
                        c[0] += 1
                        c[1] += n
                if len(of) > COUNTED:  # Spark adds up the parts
                    yield from flush(counts)
        yield from flush(counts)
        release()

    made = train.mapInArrow(run, "term string, stem boolean, toxic long, clean long, in_toxic long, in_clean long")
    return made.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in names[2:]])


def learn_terms(train: DataFrame) -> list[Term]:
    """Terms that are much more frequent in toxic rows; of stems that begin alike, the shortest. A term's weight is the
    log-odds of toxic for a document that has it."""
    sizes = {r["toxic"]: r for r in train.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    if len(sizes) < 2:
        return []
    bad, good = sizes[1], sizes[0]
    least = int(np.clip(round(0.02 * bad["n"]), 3, 8))
    odds = F.log((F.col("toxic") + 0.5) / (bad["n"] + 1)) - F.log((F.col("clean") + 0.5) / (good["n"] + 1))
    rate = F.log((F.col("in_toxic") + 0.5) / (bad["w"] + 1)) - F.log((F.col("in_clean") + 0.5) / (good["w"] + 1))
    found = candidates(train).where(F.col("toxic") >= least).withColumn("odds", odds).withColumn("rate", rate).where("rate >= 2.5 and odds >= 1.5")
    rows = found.orderBy(F.desc(F.col("rate") * F.sqrt("toxic")), "term", "stem").collect()  # out of TRAIN_DOCS texts; each stands in `least` toxic ones or more
    stems: dict[str, Term] = {}
    for r in sorted((r for r in rows if r["stem"]), key=lambda r: (len(r["term"]), r["term"])):
        if not any(r["term"][:k] in stems for k in range(STEM, len(r["term"]))):
            stems[r["term"]] = Term(r["term"], True, 1 if len(r["term"]) >= 6 else 0, min(r["odds"], 6.0))
    whole = [Term(r["term"], False, 2 if len(r["term"]) >= 9 else 1 if len(r["term"]) >= 5 else 0, min(r["odds"], 6.0)) for r in rows if not r["stem"] and r["toxic"] >= 2 * least]
    return [*stems.values(), *whole]


def read_hits(train: DataFrame, terms: list[Term]) -> DataFrame:
    """(toxic, x, found) of each training row: its features, and its distinct hits as term * 4 + edits."""

    def run(batches):
        hits = Hits(Lexicon(terms))
        for batch in batches:
            xs, fs = [], []
            for text in batch.column("text").to_pylist():
                x, found = features(text or "", hits)
                xs.append(x.tolist())
                fs.append(sorted({t * 4 + min(e, 3) for t, e in found}))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(xs, pa.list_(pa.float64())), pa.array(fs, pa.list_(pa.int32()))], names=["toxic", "x", "found"])
        del hits
        release()

    return train.mapInArrow(run, "toxic int, x array<double>, found array<int>")


def fit(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, toxic). Misspellings of a term are allowed as far as they don't stand in clean rows.
    Without rows of both labels it has no terms and scores every text alike."""
    text_batches(labelled.sparkSession)
    ids = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    tasks = 2 * labelled.sparkSession.sparkContext.defaultParallelism
    train = keep(labelled.join(ids, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")), "train", wide=True).repartition(tasks)
    terms = learn_terms(train)
    seen = read_hits(train, terms).select("toxic", F.explode("found").alias("hit")).groupBy("hit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect()
    edits = {i: t.edits for i, t in enumerate(terms)}
    for r in sorted(seen, key=lambda r: r["hit"], reverse=True):
        number, e = divmod(r["hit"], 4)
        if e and r["good"] > 0.1 * r["bad"]:
            edits[number] = min(edits[number], e - 1)
    terms = [Term(t.text, t.stem, edits[i], t.weight) for i, t in enumerate(terms)]
    rows = read_hits(train, terms).select("toxic", "x").collect()  # TRAIN_DOCS rows of FEATURES numbers at most
    if len({r["toxic"] for r in rows}) < 2:
        return Model([], np.zeros(FEATURES), -3.0)
    w, b = logistic(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return Model(terms, w, b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_model(docs: DataFrame, labels: DataFrame) -> Model:
    """fit() on the labelled rows that are not held out; rows without a label, id or text don't count."""
    mine = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = mine.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).where("text is not null")
    return fit(texts.join(ids, "doc_id"))


def score(model: Model, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty."""

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for part in parts:
            yield pa.array([of(t.as_py()) for t in part], pa.float64())
        del of
        release()

    return run(text)


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores `threshold` or more."""
    text_batches(docs.sparkSession)
    mark = fresh("_toxicity", docs)
    return docs.withColumn(mark, score(model, docs["text"])).where(F.col(mark) < threshold).drop(mark)


def op3_lexicon_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document.

    A null or empty text scores like one without hits; a null doc_id is never held out; repeated rows are scored each;
    an empty table gives no rows; without usable labels all texts score alike. Extra columns are not read.
    """
    docs = table(spark, sf_dir, "documents")
    model = train_model(docs, table(spark, sf_dir, "labels"))
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), score(model, docs["text"]).alias("score"))
    return thin.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
