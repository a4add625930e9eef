"""Toxicity by a weighted finite-state pattern grammar (operator 9).

A lexicon transducer maps words to classes (insult, weak insult, threat,
target, negation, report, other) and pattern transducers read the classes of
one clause: negation and reported speech carry a discount to the insult that
follows, a target before or after it a premium, a threat speaks with the target
that follows it. The patterns are composed into one weighted automaton over
clause states, so a class counts by the clause it stands in and not as a lone
word. A clause's weight is its strongest insult and what its arcs add.

A document is a chain of clauses. Clauses with an insult are each a sign of
their own: the score is one minus the product of their complements. Clauses
with weak insults or threats are a sign by their density only: their weights
are summed, every word of the text costs a little (the weight of the loop on
other words), and what is left is one more sign. So a stray weak word in a long
clean text says nothing, whatever the length.

The lexicon has a short list of class words and entries learned from a bounded
sample of labelled rows: whole words and stems that many inflected forms share
(``stem*``), strong where they hardly occur in clean texts, weak where they
occur there too, but many times more seldom a word. A learned stem takes the
place of the longer stems and words that it covers.

Odd input: null and empty texts, and texts without a lexicon word, score the
base rate's low end (BASE). Without labels (none, or only of one kind) the
fixed word list alone decides. Labels that are null, and labelled rows without
a document, are left out; repeated rows count once in the fit; of labelled rows
beyond the sample those of least hash and id are taken, so ties are settled. A
very long text is read once, word by word. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rows, id_and_text, materialise, small_batches, tidy

SAMPLE = 20_000  # labelled rows that a fit reads at most
PURITY = 10  # toxic training texts for each clean one that a strong entry needs
RATE = 12.0  # how many times more often, by the word, a weak entry occurs in toxic training texts
STEMS = (4, 5, 6, 7)  # lengths of the stems that a fit tries
SUPPORT, SHARE = 5, 0.02  # toxic training texts that an entry needs: so many, and this share of them
THRESHOLD = 0.3
BASE = 0.02
COST = 0.005  # what a word costs where the labels teach nothing else
INSULT, WEAK, THREAT, TARGET, NEGATION, REPORT, OTHER = range(7)

# Class words in the four languages.
WORDS = {
    THREAT: "kill hurt destroy attack beat murder töten schlagen tuer frapper matar golpear",
    TARGET: "you your they them he she him her it dich du ihr sie tu toi vous ils elle usted ellos ella",
    NEGATION: "not no never nobody without kein keine nicht nie pas jamais sin nunca",
    REPORT: "said says reported quoted wrote claimed called sagte schrieb nannte disait écrit dijo escribió llamó",
}
# Insults that need no labels, and their weight.
INSULTS, INSULT_WEIGHT = "idiot moron imbecile stupid trottel dummkopf crétin imbécile estúpido idiota", 4.0
# Natural-log weights of the pattern arcs.
ARCS = {"threat": 1.0, "target": 0.5, "negation": -0.7, "report": -0.7}

TOKEN = re.compile(r"\w+|[.!?;:\n]").findall
STOPS = set(".!?;:\n")


@dataclass
class Transducer:
    """States 0.. with arcs (state, class) -> (state, weight); a missing class loops with weight 0."""

    arcs: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.arcs.get((state, kind), (state, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same classes; states pair up and weights add."""
        out, index, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
        while todo:
            pair = todo.pop()
            for kind in range(7):
                (a, v), (b, w) = self.step(pair[0], kind), other.step(pair[1], kind)
                if (a, b) not in index:
                    index[a, b] = len(index)
                    todo.append((a, b))
                if (a, b) != pair or v + w:
                    out.arcs[index[pair], kind] = index[a, b], v + w
        return out


def grammar() -> Transducer:
    """The clause patterns, composed. State 0 is the clause's start."""
    target, negation, report = Transducer(), Transducer({(0, NEGATION): (1, 0.0)}), Transducer({(0, REPORT): (1, 0.0)})
    target.arcs[0, TARGET] = 1, 0.0
    for kind in (INSULT, WEAK):
        target.arcs |= {(1, kind): (3, ARCS["target"]), (0, kind): (2, 0.0), (2, TARGET): (3, ARCS["target"])}
    for kind in (INSULT, WEAK, THREAT):
        negation.arcs[1, kind] = 0, ARCS["negation"]
        report.arcs[1, kind] = 1, ARCS["report"]
    threat = Transducer({(0, THREAT): (1, 0.0), (1, TARGET): (2, ARCS["threat"])})
    return target.compose(threat).compose(negation).compose(report)


@dataclass
class Lexicon:
    """Learned entries (word or ``stem*`` -> weight), strong and weak, and the cost of a word."""

    strong: dict[str, float] = field(default_factory=dict)
    weak: dict[str, float] = field(default_factory=dict)
    cost: float = COST


class Scorer:
    """Scores texts with the fixed class words and a learned lexicon."""

    def __init__(self, learned: Lexicon):
        self.classes = {w: k for k, ws in WORDS.items() for w in ws.split()}
        entries = {e: (WEAK, w) for e, w in learned.weak.items()} | {e: (INSULT, w) for e, w in learned.strong.items()}
        self.words = dict.fromkeys(INSULTS.split(), (INSULT, INSULT_WEIGHT)) | {e: v for e, v in entries.items() if not e.endswith("*")}
        self.stems = {e[:-1]: v for e, v in entries.items() if e.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems}, reverse=True)
        self.cost = learned.cost
        self.machine = grammar()
        self.seen: dict[str, tuple[int, float]] = {}

    def lexicon(self, word: str) -> tuple[int, float]:
        """The lexicon transducer: class and weight of a word; the longest stem wins."""
        if (v := self.words.get(word)) is not None:
            return v
        if (k := self.classes.get(word)) is not None:
            return k, 0.0
        for n in self.lengths:
            if len(word) >= n and (v := self.stems.get(word[:n])) is not None:
                return v
        return OTHER, 0.0

    def _class(self, word: str) -> tuple[int, float]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 300_000:
                self.seen.clear()
            got = self.seen[word] = self.lexicon(word)
        return got

    def clauses(self, text: str):
        """(whether it has a strong insult, weight, words) of each clause; weight 0 where no pattern matches."""
        state, weight, strong, weak, threat, n = 0, 0.0, 0.0, 0.0, False, 0
        known = self._class
        for token in TOKEN(text.lower()):
            if token in STOPS:
                if n:
                    yield strong > 0, max(strong, weak) + weight if strong or weak or threat else 0.0, n
                state, weight, strong, weak, threat, n = 0, 0.0, 0.0, 0.0, False, 0
                continue
            n += 1
            kind, own = known(token)
            if kind != OTHER:
                state, gain = self.machine.step(state, kind)
                weight += gain
                threat |= kind == TARGET and gain >= ARCS["threat"]
                if kind == INSULT:
                    strong = max(strong, own)
                elif kind == WEAK:
                    weak += own
        if n:
            yield strong > 0, max(strong, weak) + weight if strong or weak or threat else 0.0, n

    def score(self, text: str) -> float:
        clean, density = 1 - BASE, 0.0
        for strong, w, n in self.clauses(text):
            density -= self.cost * n
            if strong:
                clean *= 1 - sign(w)
            else:
                density += w
        if density > 0:
            clean *= 1 - sign(density)
        return min(1.0, max(0.0, 1 - clean))


def sign(weight: float) -> float:
    return 1 / (1 + math.exp(2.0 - weight))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """The learned lexicon, from at most ``sample`` labelled rows.

    The sample is the rows of least hash of their id, which bounds every count.
    Counts are made on the executors, and only entries that separate the labels
    reach the driver.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND label_id IS NOT NULL")
    rows = rows.filter(~held_out("label_id")).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    names = ["pos", "neg", "pos_uses", "neg_uses"]  # texts and words of either label
    out = Rows(entry="string", **dict.fromkeys(names, "long"))

    def features(batches):
        for part in small_batches(batches, column="text"):
            texts: tuple[Counter, Counter] = Counter(), Counter()
            uses: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = Counter(TOKEN(text.lower()))
                found: Counter = Counter({"": words.total()})  # counts the documents
                for w, n in words.items():
                    if len(w) > 2:
                        found[w] += n
                        for k in STEMS:
                            if len(w) >= k:
                                found[w[:k] + "*"] += n
                uses[toxic].update(found)
                texts[toxic].update(found.keys())
            entries = list(texts[0] | texts[1])
            yield out.batch(entries, *([c[e] for e in entries] for c in (texts[1], texts[0], uses[1], uses[0])))

    train = id_and_text(docs).join(F.broadcast(rows), F.col("doc_id") == F.col("label_id"))
    # Copies count once: the words of a much copied text say nothing about its label.
    train = train.groupBy(F.xxhash64("text").alias("copy")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    counts = train.mapInArrow(tidy(features), out.schema).groupBy("entry").agg(*[F.sum(c).alias(c) for c in names])
    counts = materialise(counts.filter((F.col("entry") == "") | (F.col("pos") >= SUPPORT)), "entries")
    total = counts.filter("entry = ''").head()
    if total is None or not total.pos or not total.neg:
        return Lexicon()
    pos, neg, pos_uses, neg_uses = (F.col(c) for c in names)
    strong = pos >= PURITY * neg
    weak = (pos_uses / total.pos_uses >= RATE * neg_uses / total.neg_uses) & (pos_uses >= 2 * pos)
    found = counts.filter((F.col("entry") != "") & (pos >= SHARE * total.pos) & (strong | weak)).collect()
    return learned_lexicon([tuple(r) for r in found], tuple(total)[1:])


def learned_lexicon(rows: list[tuple], total: tuple) -> Lexicon:
    """Weights of the rows (entry, pos, neg, pos_uses, neg_uses); entries that a kept stem covers go."""
    out, loss = Lexicon(), [0.0, 0.0]
    stems: set[str] = set()
    for entry, pos, neg, pos_uses, neg_uses in sorted(rows, key=lambda r: (len(r[0].rstrip("*")), not r[0].endswith("*"), r[0])):
        pure = pos >= PURITY * neg
        body = entry.rstrip("*")
        if any(body[:k] in stems for k in STEMS if k <= len(body)):
            continue
        weight = math.log((pos + 0.5) / (neg + 0.5) * (total[1] + 1) / (total[0] + 1)) if pure else math.log(pos_uses / total[2] / ((neg_uses + 0.5) / total[3]))
        if weight <= 2:
            continue
        (out.strong if pure else out.weak)[entry] = weight
        if entry.endswith("*"):
            stems.add(body)
        if not pure:
            loss = [loss[0] + pos_uses * weight / total[2], loss[1] + neg_uses * weight / total[3]]
    # Midway between what a word of a clean and of a toxic text weighs on average.
    out.cost = max(COST, sum(loss) / 2)
    return out


def held_out(column: str):
    """Rows kept from every fit: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, learned: Lexicon) -> DataFrame:
    """``doc_id, score, predicted`` from the text alone."""
    rows = Rows(doc_id="long", score="double", predicted="int")

    def run(batches):
        scorer = Scorer(learned)
        for batch in small_batches(batches):
            scores = [round(scorer.score(t), 9) for t in batch.column(1).to_pylist()]
            yield rows.batch(batch.column(0), scores, [int(s >= THRESHOLD) for s in scores])

    return id_and_text(docs).mapInArrow(tidy(run), rows.schema)


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, learned: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, each judged by itself; all columns."""
    place = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(learned)
        for batch in small_batches(batches, column=text_col):
            yield batch.filter(pa.array([scorer.score(t or "") < THRESHOLD for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
