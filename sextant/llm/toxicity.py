"""Toxicity by a weighted finite-state pattern grammar (operator 4).

The first transducer reads letters: a trie whose arcs turn a word into a symbol (harm of some kind, target, negation,
reporting word) and give it a weight. Its harm arcs are word lists of three kinds, and words and stems that labelled rows
teach: arcs over which toxic rows pass more often than chance explains. Three small transducers then read the symbols of a clause and mark the
harm in it: what a negation covers, what is reported speech, what stands with a target. Composed, they read a clause
once, and once backwards for targets that follow. Weights of arcs add up: a match weighs what its word and its marks
weigh, a clause what its matches weigh, and a text's log-odds are those of all labelled rows plus the weights of its
different matches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Word lists of the grammar, in English, French, German and Spanish.
INSULTS = """
arsehole asshole bastard bitch cretin degenerate dimwit dumbass fool halfwit idiot idiots imbecile jackass jerk moron
morons parasite parasites retard scum scumbag stupid subhuman vermin idiote imbécile crétin connard connasse salaud
abruti débile dummkopf arschloch abschaum vollidiot schwachkopf miststück idiota imbécil estúpido estúpida cabrón
escoria gilipollas tarado
""".split()
SLIGHTS = """
clown clowns coward disgusting filth filthy garbage hopeless loser losers pathetic pig repulsive rubbish trash
ugly useless worthless wretch ordure minable dégoûtant nul wertlos erbärmlich widerlich basura patético asqueroso
inútil
""".split()
THREATS = """
behead beat burn butcher choke crush destroy drown hang hurt kill lynch murder punish rape shoot slaughter smash
stab strangle suffer tuer tuerai crever umbringen töten sterben matar mataré morir
""".split()
TARGETS = """
you your yours yourself he him she her they them their everyone those people ya u tu toi te vous votre vos du dich dir
dein deine ihr euch sie tú ti usted ustedes vosotros él ella ellos
""".split()
NEGATIONS = """
not no never neither nor cannot without isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't couldn't
ne pas jamais nicht kein keine nie sin nunca jamás
""".split()
REPORTS = """
said says say saying wrote writes told tells called calls quoted quotes claimed claims reported alleged according
shouted yelled replied asked stated words dit disait écrit appelé sagte schrieb nannte laut dijo escribió llamó según
""".split()
#: Chance that a listed word of a kind is toxic before labels say so, and log-odds that marks add.
KINDS = {"insult": (INSULTS, 0.75), "slight": (SLIGHTS, 0.6), "threat": (THREATS, 0.05), "learned": ([], 0.5)}
ADDED = {"negated": -1.5, "reported": -1.0, "directed": 1.0}
#: Labelled rows that a listed chance is worth, and words that a negation reaches over.
PRIOR_ROWS, REACH = 4.0, 3
#: Labelled rows of each class that arcs are learned from, drawn by a hash of the id.
SAMPLE = 6000
#: Letters of a stem, and the longest word that has an arc of its own.
STEM, WORD = (3, 10), 40
#: Rows that an arc must have, the least log-odds it must add, and the share of a stem's toxic rows from which one longer arc stands for it.
ROWS, LEAST, SAME = 3, 3.0, 0.9
#: Arcs that a counting task holds before it passes them on.
HELD = 500_000


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (symbol out, weight, next state). Other symbols pass unchanged, weight 0."""

    start: object
    arcs: dict[tuple[object, str], tuple[str, float, object]]

    def step(self, state: object, symbol: str) -> tuple[str, float, object]:
        return self.arcs.get((state, symbol), (symbol, 0.0, state))

    def states(self) -> set:
        return {self.start, *(s for s, _ in self.arcs), *(n for _, _, n in self.arcs.values())}

    def symbols(self) -> set[str]:
        return {x for _, x in self.arcs} | {o for o, _, _ in self.arcs.values()}

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what self gives, other reads; weights add."""
        arcs = {}
        alphabet = self.symbols() | other.symbols()
        todo, seen = [(self.start, other.start)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            for symbol in alphabet:
                mid, w1, s1 = self.step(pair[0], symbol)
                out, w2, s2 = other.step(pair[1], mid)
                if (out, w1 + w2, (s1, s2)) != (symbol, 0.0, pair):
                    arcs[pair, symbol] = (out, w1 + w2, (s1, s2))
                todo.append((s1, s2))
        return Transducer((self.start, other.start), arcs)

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = self.start, []
        for symbol in symbols:
            to, weight, state = self.step(state, symbol)
            out.append((to, weight))
        return out


def _marks() -> list[str]:
    """Harm symbols with any marks so far."""
    return [k + m for k in KINDS for m in ("", *("".join(p) for p in product("n", "r", "d")), "n", "r", "d", "nr", "nd", "rd")]


def negation() -> Transducer:
    """A negation marks harm within the next REACH words."""
    arcs: dict = {}
    for left in range(REACH + 1):
        arcs[left, "N"] = ("N", 0.0, REACH)
        if left:
            arcs[left, "w"] = ("w", 0.0, left - 1)
            for other in ("Y", "R"):
                arcs[left, other] = (other, 0.0, left - 1)
            for k in KINDS:
                arcs[left, k] = (k + "n", ADDED["negated"], left - 1)
    return Transducer(0, arcs)


def reported() -> Transducer:
    """A reporting word or a quotation mark marks harm up to the clause's end or the closing mark."""
    arcs: dict = {("plain", "R"): ("R", 0.0, "said"), ("plain", "Q"): ("Q", 0.0, "quoted"), ("said", "Q"): ("Q", 0.0, "quoted"), ("quoted", "Q"): ("Q", 0.0, "plain")}
    for state, k in product(("said", "quoted"), _marks()):
        if "r" not in k[len("insult") :]:
            arcs[state, k] = (k + "r", ADDED["reported"], state)
    return Transducer("plain", arcs)


def directed() -> Transducer:
    """A target marks harm after it in the clause."""
    arcs: dict = {("none", "Y"): ("Y", 0.0, "some")}
    for k in _marks():
        if "d" not in k[len("insult") :]:
            arcs["some", k] = (k + "d", ADDED["directed"], "some")
    return Transducer("none", arcs)


FORWARD = reduce(lambda a, b: a @ b, (negation(), reported(), directed()))
BACKWARD = directed()
LISTED = {w: s for s, words in (("Y", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
_HARM = frozenset(_marks())
_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[\"“”«»„]")
_WORD = re.compile(r"\w+(?:['’]\w+)?")


def arcs_of(word: str) -> list[str]:
    """The arcs that a word may take, the longest first: the word itself, which ends with $, and its stems."""
    stems = [word[:k] for k in range(min(len(word), STEM[1]), STEM[0] - 1, -1)]
    return [word + "$", *stems] if STEM[0] <= len(word) <= WORD else stems


@dataclass
class Lexicon:
    """The transducer of words: arcs with kind and weight, and the log-odds of a text without a match.

    A word takes its longest arc; arcs of weight 0 are exceptions to shorter ones.
    """

    arcs: dict[str, tuple[str, float]]
    bias: float

    def __post_init__(self) -> None:
        self.heads = {a[: STEM[0]] for a, (_, w) in self.arcs.items() if w > 0}

    def read(self, word: str) -> tuple[str, float]:
        if word[: STEM[0]] in self.heads:
            for a in arcs_of(word):
                if a in self.arcs:
                    kind, weight = self.arcs[a]
                    return (kind, weight) if weight > 0 else ("w", 0.0)
        return "w", 0.0

    def clause(self, text: str) -> dict[str, float]:
        """Harm words of a lower-case clause, each with the best weight of its matches, marks included."""
        symbols, weights, words = [], [], []
        for t in _TOKEN.findall(text):
            t = t.replace("’", "'")
            symbol, weight = ("Q", 0.0) if not t[0].isalnum() and t[0] != "_" else (LISTED[t], 0.0) if t in LISTED else self.read(t)
            symbols.append(symbol)
            weights.append(weight)
            words.append(t)
        out = FORWARD.run(symbols)
        back = BACKWARD.run([s for s, _ in out][::-1])[::-1]  # a target after the harm word counts as well
        found: dict[str, float] = {}
        for word, weight, (_, marks), (symbol, directed_) in zip(words, weights, out, back, strict=True):
            if symbol in _HARM:
                found[word] = max(found.get(word, 0.0), weight + marks + directed_)
        return found

    def odds(self, text: str) -> float:
        """Log-odds that a text is toxic. Each word counts once, where it weighs most."""
        text = text.lower()
        hits = [w for w in set(_WORD.findall(text)) if w[: STEM[0]] in self.heads and self.read(w.replace("’", "'"))[1] > 0]
        if not hits:
            return self.bias
        found: dict[str, float] = {}
        some = re.compile("|".join(map(re.escape, hits)))
        for c in _CLAUSE.findall(text):
            if some.search(c):
                for word, weight in self.clause(c).items():
                    found[word] = max(found.get(word, 0.0), weight)
        return self.bias + sum(found.values())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.odds(text)))))


def copy_key(text: str) -> int:
    """Least hash of four neighbouring words: nearly all copies and near copies of a text share it."""
    words = _WORD.findall(text.lower())
    n = min(xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3)))
    return n - (1 << 64) if n >> 63 else n


def sample(docs: DataFrame, labels: DataFrame, train: Column | None, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """text and y of drawn labelled rows, and how many ids with a label are toxic and clean.

    docs: id_col, text_col; train: a condition on column id. SAMPLE ids of a class at most are drawn, and of rows that are copies of each
    other one stays, so a text that stands often teaches nothing by that.
    """
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col].cast("int")).alias("y"))
    known = materialize(known if train is None else known.where(train), "labelled")
    sizes = {r["y"] > 0: r["n"] for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(on).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for on in ("y > 0", "y <= 0")]
    ids = materialize(drawn[0].unionByName(drawn[1]).select(F.col("id").alias("k"), F.col("y").alias("label")), "drawn")  # 2 * SAMPLE rows at most
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null")
    rows = src.join(F.broadcast(ids), F.col("id") == F.col("k")).select("text", (F.col("label") > 0).cast("int").alias("y"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches):
            keys = [copy_key(v.decode("utf-8", "replace")) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["text", "y", "copy"])

    keyed = rows.mapInArrow(run, "text string, y int, copy long")
    own = materialize(keyed.groupBy("copy", "y").agg(F.min("text").alias("text")).select("text", "y"), "sample")
    return own, sizes.get(True, 0), sizes.get(False, 0)


def counted(rows: DataFrame) -> DataFrame:
    """arc, y and c: of each arc the toxic and the clean rows of (text, y) that could take it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            arcs = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(arcs, pa.string()), *(pa.array([held[k][a] for a in arcs], pa.int64()) for k in (1, 0))], ["arc", "y", "c"])

        for batch, values in slices(batches):
            for v, y in zip(values, batch.column(1).to_pylist(), strict=True):
                words = {w.replace("’", "'") for w in _WORD.findall(v.decode("utf-8", "replace").lower())}
                held[y].update({a for w in words for a in arcs_of(w)})
                if len(held[0]) + len(held[1]) > HELD:
                    yield out()
                    held[0].clear()
                    held[1].clear()
        yield out()

    return rows.select("text", "y").mapInArrow(run, "arc string, y long, c long").groupBy("arc").agg(F.sum("y").alias("y"), F.sum("c").alias("c"))


def ratio(y: Column, c: Column, toxic: int, clean: int) -> Column:
    """Log of how much more often toxic rows pass an arc than clean ones do."""
    return F.log((y + 0.5) / F.lit(toxic + 1.0)) - F.log((c + 0.5) / F.lit(clean + 1.0))


def surprise(y: Column, c: Column, toxic: int, clean: int) -> Column:
    """Twice the log-likelihood ratio between an arc that tells toxic rows and one that does not."""
    n, rows = y + c, toxic + clean
    cells = ((y, n * toxic / rows), (c, n * clean / rows), (toxic - y, (rows - n) * toxic / rows), (clean - c, (rows - n) * clean / rows))
    return 2 * reduce(lambda a, b: a + b, [F.when((seen > 0) & (due > 0), seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells])


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of arcs (toxic rows, weight) without stems that stand for one longer arc alone."""
    kept: dict[str, float] = {}
    for arc in sorted(found, key=lambda a: (-len(a), a)):
        n, weight = found[arc]
        if not any(longer.startswith(arc) and found[longer][0] >= SAME * n for longer in kept):
            kept[arc] = weight
    return kept


def learn(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """The lexicon from word lists and labelled rows. An arc is learned if it is less likely by chance than one in all arcs counted."""
    rows, n_toxic, n_clean = sample(docs, labels, train, id_col, text_col, label_col)
    bias = min(math.log(0.45 / 0.55), math.log((n_toxic + 0.02) / (n_clean + 0.98)))
    counts = materialize(counted(rows), "arcs")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    y, c = F.col("y"), F.col("c")
    words = [w for listed, _ in KINDS.values() for w in listed]
    seen = {r["arc"][:-1]: (r["y"] + r["c"], r["w"]) for r in counts.where(F.col("arc").isin([w + "$" for w in words])).select("arc", "y", "c", ratio(y, c, toxic, clean).alias("w")).collect()}
    arcs: dict[str, tuple[str, float]] = {}
    if toxic and clean:
        every = counts.count()
        told = counts.where((y >= ROWS) & (ratio(y, c, toxic, clean) >= LEAST) & (surprise(y, c, toxic, clean) >= 2 * math.log(every)))
        kept = specific({r["arc"]: (r["y"], r["w"]) for r in told.select("arc", "y", ratio(y, c, toxic, clean).alias("w")).collect()})  # few: toxic rows of the sample bound them
        stems = [a for a in kept if not a.endswith("$")]
        arcs = {a: ("learned", w) for a, w in kept.items()}
        if stems:
            longer = F.expr(f"transform(sequence({STEM[0]}, greatest({STEM[0]}, length(arc) - 1)), k -> substring(arc, 1, k))")
            under = counts.where((c >= ROWS) & (F.length("arc") > STEM[0])).where(F.arrays_overlap(longer, F.array(*map(F.lit, stems))))
            arcs |= {r["arc"]: ("learned", 0.0) for r in under.where(ratio(y, c, toxic, clean) < LEAST).select("arc").collect() if r["arc"] not in kept}
    for kind, (listed, chance) in KINDS.items():
        for w in listed:
            n, weight = seen.get(w, (0, 0.0))
            own = (n * weight + PRIOR_ROWS * (math.log(chance / (1 - chance)) - bias)) / (n + PRIOR_ROWS)
            arcs[w + "$"] = (kind, max(0.0, own))
    return Lexicon(arcs, bias)


def _scores(lexicon: Lexicon, values: list[bytes]) -> np.ndarray:
    return np.array([lexicon.score(v.decode("utf-8", "replace")) for v in values])


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: id_col, score (0 to 1) and predicted (1 from 0.5 on).

    train: a condition on column id, which labels may be learned from. Null and empty texts have the score of a
    text without a match; repeated rows are scored alike and teach once; an id with several labels is toxic if one says so, null
    labels and labels of null ids don't count; without labels the word lists stand alone; an empty table gives an empty one; other columns don't matter.
    Texts are read twice, for the sample and for the scores, and don't move.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, train, id_col, text_col))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(lexicon.value, values))], ["id", "score"])

    rows = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double")
    return rows.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not predicted toxic; no row moves. Rows that share an id are judged each by its text."""
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, None, id_col, text_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in slices(batches, text_col):
            yield batch.filter(pc.less(pa.array(_scores(lexicon.value, values)), 0.5))

    return docs.mapInArrow(run, docs.schema)
