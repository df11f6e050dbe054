"""Language identification by cross-parsing against suffix automata (operator 8).

For each language a suffix automaton holds labelled text: the whole texts of a bounded sample of labelled documents,
in lower case, words parted by one space. A document in the same form is parsed from left to right into phrases, each
the longest match that the automaton allows; a character that it lacks is a phrase of its own. A phrase costs about
log2 of the labelled text's length in bits (it points to a place there), so that languages with little text aren't
favoured; the language whose phrases cost least over the whole text wins.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import held, over_texts, small_batches

_GAPS = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Lower-case words of letters (Unicode category L) between single spaces, one at each end; empty without letters."""
    x = _GAPS.sub(" ", text.lower())
    if not x.isascii():  # numerals that aren't decimal, such as fractions and Roman ones, are left
        import regex

        x = regex.sub(r"\P{L}+", " ", x)
    x = x.strip(" ")
    return f" {x} " if x else ""


class SuffixAutomaton:
    """Recognises the substrings of a text; a state is a dictionary from characters to states."""

    def __init__(self, text: str):
        self.root: dict = {}
        states, link, length, last = [self.root], [-1], [0], 0
        for c in text:
            new = len(states)
            length.append(length[last] + 1)
            states.append({})
            link.append(0)
            p = last
            while p >= 0 and c not in states[p]:
                states[p][c] = new
                p = link[p]
            if p >= 0:
                q = states[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(states)
                    length.append(length[p] + 1)
                    states.append(dict(states[q]))
                    link.append(link[q])
                    while p >= 0 and states[p].get(c) == q:
                        states[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        for state in states:
            for c, to in state.items():
                state[c] = states[to]
        self.bits = math.log2(len(text) + 2)

    def phrases(self, text: str) -> int:
        """How many longest matches the text falls into; a character that the automaton lacks is one by itself."""
        root, n = self.root, 0
        first, state = root.get, root
        for c in text:
            if (to := state.get(c)) is None:
                n += state is not root
                if (to := first(c)) is None:
                    n += 1
                    to = root
            state = to
        return n + (state is not root)


def labelled_text(docs: DataFrame, *, sample_docs: int = 400, sample_chars: int = 60_000, key: str = "doc_id", text: str = "text", label: str = "lang") -> dict[str, str]:
    """Language to the whole texts of a sample of its documents, in the form of ``normal``.

    Documents are taken by a hash of their keys, about ``sample_docs`` of each language, and of these in turn as long
    as their texts together have at most ``sample_chars`` characters; ones of over an eighth of that come last, the
    shortest first. The first one is always taken, so that no language with letters is left out. The driver and each
    worker hold about that many characters a language.
    """
    rows = docs.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t"), F.length(text).alias("n"))
    counts = rows.groupBy("l").agg(F.count(F.lit(1)).alias("docs"))
    share = F.shiftrightunsigned(F.xxhash64("k"), 1) / F.lit(float(1 << 63))
    # a row for each label: far less than the texts of each label that the driver gets
    some = rows.join(F.broadcast(counts), "l").where(share * F.col("docs") < sample_docs).withColumn("size", F.greatest("n", F.lit(sample_chars // 8)))
    order = Window.partitionBy("l").orderBy("size", share, "k", "t")
    taken = some.withColumn("nth", F.row_number().over(order)).withColumn("held", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    got = taken.where((F.col("nth") == 1) | (F.col("held") <= sample_chars)).select("l", "nth", "t").collect()
    model: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r["l"], r["nth"])):
        model[r["l"]] = model.get(r["l"], " ") + normal(r["t"])[1:]
    return model


def _predictor(model: dict[str, str]):
    """Function for a task that returns (language, score) of a text."""
    names = sorted(model)
    mark = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()

    def make():
        automata = held(("language", mark), lambda: [SuffixAutomaton(model[n]) for n in names])

        def one(x: str | None):
            text = normal(x or "")
            if not text or not names:
                return "und", 0.0
            cost = sorted((a.phrases(text) * a.bits, n) for a, n in zip(automata, names))
            return cost[0][1], cost[1][0] / (cost[0][0] + cost[1][0]) if len(cost) > 1 else 1.0

        return one

    return make


def predict(docs: DataFrame, model: dict[str, str], *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every whole text. ``und`` with score 0 if it is null or has no letters, or if the
    model is empty; else the score is the second language's cost over both costs (1 if there is only one). Of equal
    costs the first label counts. One row for each input row, repeated ones too, none for a table without rows; columns but
    key and text are not read, whatever their names."""
    make = _predictor(model)

    def many():
        one = make()
        return lambda texts: [one(x) for x in texts]

    return over_texts(docs, many, "lang_pred string, score double", key=key, text=text)


def keep_known(docs: DataFrame, model: dict[str, str], *, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose text isn't predicted ``und``; of an empty table none."""
    import pyarrow as pa

    make, at = _predictor(model), docs.columns.index(text)

    def run(batches):
        one = make()
        for batch in batches:
            yield batch.filter(pa.array([one(x)[0] != "und" for x in batch.column(at).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """True for the fold that isn't learned from; a null key is never held out, nor learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, *, folds: int = 5, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out and predict all: ``key, held_out, lang_pred, score``."""
    model = labelled_text(docs.where(~held_out(key, folds) & F.col(key).isNotNull()), key=key, text=text, label=label)
    out = predict(docs, model, key=key, text=text)
    return out.select(key, held_out(key, folds).alias("held_out"), "lang_pred", "score")
