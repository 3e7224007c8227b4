"""Language identification (operator 8): multinomial naive Bayes over hashed character n-grams.

Counts of 1- to 3-grams of lower-cased characters, hashed to 2**BITS slots, are summed per language over a bounded
sample of labelled rows. The matrix of log-probabilities (languages x 2**BITS floats) is broadcast; a batch of texts is
scored by gathering the rows of its n-grams and adding them up per text in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BITS = 16
#: Rows of each language to learn from, about, the most languages (of more, the most frequent ones are learned) and the
#: most numbers of the model: they bound it and what it costs. Over 256 languages share fewer slots.
SAMPLE, LANGUAGES, NUMBERS = 4000, 4096, 24
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def bits_for(languages: int) -> int:
    """Slots, as a power of two, so that all languages have 2**NUMBERS of them at most."""
    return min(BITS, NUMBERS - max(0, languages - 1).bit_length())


def grams_of(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the n-grams of all texts, and of each text where its own begin (and the end).

    Characters that aren't letters count as spaces within ASCII.
    """
    plain = np.arange(128, dtype=np.uint32)
    plain[[c for c in range(128) if not chr(c).isalpha()]] = 32
    joined = " ".join(t.lower() for t in texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    c = np.where(c < 128, plain[np.minimum(c, 127)], c)
    lens = np.fromiter((len(t.lower()) + 1 for t in texts), np.int64, len(texts))
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lens)))
    n = len(c)
    slots = np.empty((n, 3), np.uint32)
    with np.errstate(over="ignore"):
        two = np.zeros(n, np.uint32)
        two[:-1] = c[:-1] * np.uint32(0x01000193) + c[1:] + np.uint32(1)
        three = np.zeros(n, np.uint32)
        three[:-2] = two[:-2] * np.uint32(0x01000193) + c[2:] + np.uint32(7)
        for k, h in enumerate((c, two, three)):
            slots[:, k] = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    edge = ends[1:] - 1  # n-grams that reach into the next text count as the text's last space
    slots[edge] = slots[edge, :1]
    inner = edge - 1
    inner = inner[inner >= ends[:-1]]
    slots[inner, 2] = slots[inner, 1]
    return slots, ends


def learn(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities (2**bits_for(languages) x languages) and log-priors.

    Of a language with more than SAMPLE rows those are taken whose hashed id is low; priors are from all rows.
    """
    rows = docs.where(train & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"), F.pmod(F.xxhash64(docs[id_col]), F.lit(1 << 20)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs, bits = sorted(sizes), bits_for(len(sizes))
    if not langs:
        return [], np.zeros((1 << bits, 0), np.float32), np.zeros(0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1 << 20, -(-SAMPLE * (1 << 20) // sizes[k])))])
    number = {k: i for i, k in enumerate(langs)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(langs), 1 << bits), np.int64)
        for batch, values in slices(batches):
            slots, ends = grams_of([v.decode("utf-8", "replace") for v in values], bits)
            own = np.array([number[x] for x in batch.column(0).to_pylist()])
            who = np.repeat(own, np.diff(ends))
            for k in range(3):
                table += np.bincount(who * (1 << bits) + slots[:, k], minlength=table.size).reshape(table.shape)
        lang, slot = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(table[lang, slot])], ["lang", "slot", "n"])

    drawn = rows.where(F.col("lang").isin(langs)).where(F.col("draw") < F.element_at(share, F.col("lang"))).select("lang", "text")
    found = drawn.mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # 2**NUMBERS rows at most
    table = np.zeros((1 << bits, len(langs)))
    table[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    table += 0.5
    prior = np.log(np.array([sizes[k] for k in langs], float) / sum(sizes.values()))
    return langs, np.log(table / table.sum(0)).astype(np.float32), prior


def predict(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, lang_pred and score (posterior of lang_pred, 0 to 1) of every row, learned from the rows where train holds.

    Null texts and texts without a letter: UNKNOWN, 0.0; so for all if there is nothing to learn from. Rows with null lang aren't
    learned from; repeated rows count as often as they stand; an empty table gives an empty one. Whole texts count.
    """
    langs, table, prior = learn(docs, train, text_col, lang_col, id_col)
    model = docs.sparkSession.sparkContext.broadcast((langs, table, prior))
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table, prior = model.value
        for batch, values in slices(batches, limit=1 << 20):
            texts = [v.decode("utf-8", "replace") for v in values]
            known = np.array([bool(_LETTER.search(t)) for t in texts]) & (len(langs) > 0)
            pred, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            at = np.flatnonzero(known)
            if len(at):
                slots, ends = grams_of([texts[k] for k in at], table.shape[0].bit_length() - 1)
                total = np.tile(prior, (len(at), 1))
                for lo in range(0, len(slots), 1 << 19):  # a long text in several parts
                    hi = min(len(slots), lo + (1 << 19))
                    i = int(np.searchsorted(ends, lo, side="right")) - 1
                    j = int(np.searchsorted(ends, hi, side="left"))
                    cut = np.maximum(ends[i:j] - lo, 0)
                    for k in range(3):
                        total[i:j] += np.add.reduceat(table[slots[lo:hi, k]], cut, axis=0, dtype=np.float64)
                best = total.argmax(1)
                total -= total.max(1, keepdims=True)
                pred[at] = np.array(langs, object)[best]
                score[at] = 1 / np.exp(total).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
