"""Scores of the names that files define, some thousands of files at a time: a line that many of them hold is read once,
and what it says of the lines below it in its file is worked out on arrays of numbers. The rules are those of
``where_they_are.facts`` and ``where_they_are.typed_callees``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.code import CALLED, CALLER
from marlstone.operators.where_they_are import line_facts

if TYPE_CHECKING:
    import pyarrow as pa

#: Bytes of text that a worker takes together; a larger file is taken alone.
BYTES = 1 << 23
#: Words with a number of their own: none, those that a call can be on, and the module of builtins.
_FIRST = ["", "self", "cls", "super", "builtins"]
_NONE, _SELF, _CLS, _SUPER, _BUILTINS = range(len(_FIRST))
_CALL, _IMPORT, _DEF, _CLASS = range(1, 5)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs that begin at ``first`` with ``count`` members: which run a member is of, and where it stands."""
    of = np.repeat(np.arange(len(count)), count)
    return of, np.arange(len(of)) + np.repeat(first - np.cumsum(count) + count, count)


class _Lines:
    """Different lines: their kinds, and the numbers of the words of definitions, imports and calls."""

    def __init__(self, lines: np.ndarray, builtins: list[str]) -> None:
        import pyarrow as pa

        kind, first, count, indented, at_margin = ([x] * len(lines) for x in (0, 0, 0, False, False))
        names, imports, calls = [], [], []
        for at, line in enumerate(lines):
            read = line_facts(line, True)
            if not read:
                continue
            if read[0] == "call":
                kind[at], first[at], count[at] = _CALL, len(calls), len(read[1])
                calls += read[1]
            elif read[0] == "import":
                some = [(alias, target) for alias, target, star in read[1] if not star]
                kind[at], first[at], count[at] = _IMPORT, len(imports), len(some)
                imports += some
            else:
                word, indent, name, _, at_margin[at] = read
                kind[at], first[at], indented[at] = _DEF if word == "def" else _CLASS, len(names), bool(indent)
                names.append(name or "")
        self.kind, self.first, self.count = np.array(kind, np.int8), np.array(first, np.int64), np.array(count, np.int64)
        self.indented, self.at_margin = np.array(indented, bool), np.array(at_margin, bool)
        aliases, targets = zip(*imports, strict=True) if imports else ((), ())
        callees, heads, objects, methods = zip(*calls, strict=True) if calls else ((), (), (), ())
        tails = [callee[len(head) + 1 :] for callee, head in zip(callees, heads, strict=True)]
        parts = [_FIRST, builtins, names, aliases, targets, callees, heads, objects, methods, tails]
        numbered = pa.array([x for part in parts for x in part], pa.string()).dictionary_encode()
        self.words = numbered.dictionary
        ends = np.cumsum([len(part) for part in parts])[:-1]
        _, known, names, self.alias, self.target, self.callee, self.head, self.object, self.method, self.tail = np.split(numbered.indices.to_numpy().astype(np.int64), ends)
        self.builtin = np.zeros(len(self.words), bool)
        self.builtin[known] = True
        self.name = np.where(self.kind >= _DEF, np.append(names, _NONE)[np.where(self.kind >= _DEF, self.first, -1)], _NONE)


def _imported(lines: _Lines, file: np.ndarray, line: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The largest target that a file's imports give the word that is asked for, as file times words plus word; or -1."""
    import pyarrow.compute as pc

    of, at = _spread(lines.first[line], lines.count[line])
    keys, targets = file[of] * len(lines.words) + lines.alias[at], lines.target[at]
    order = np.argsort(keys, kind="stable")
    if (np.diff(keys[order]) == 0).any():
        rank = np.empty(len(lines.words), np.int64)
        rank[pc.array_sort_indices(lines.words).to_numpy()] = np.arange(len(lines.words))
        order = np.lexsort((rank[targets], keys))
    keys, targets = np.append(-1, keys[order]), np.append(-1, targets[order])
    last = np.searchsorted(keys, asked, "right") - 1
    return np.where(keys[last] == asked, targets[last], -1)


def _scores(texts: pa.Array, builtins: list[str]) -> pa.RecordBatch | None:
    """``full_name, defined, score`` of some files."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(texts, "\n")
    each = parts.flatten().dictionary_encode()
    lines = _Lines(each.dictionary.to_numpy(zero_copy_only=False), builtins)
    line = each.indices.to_numpy()
    tell = np.flatnonzero(lines.kind[line])
    if not len(tell):
        return None
    file, line = pc.list_parent_indices(parts).to_numpy()[tell], line[tell]
    kind, name, indented, here = lines.kind[line], lines.name[line], lines.indented[line], np.arange(len(tell))
    begin = np.maximum.accumulate(np.where(np.diff(file, prepend=-1) != 0, here, 0))

    def last(flag: np.ndarray) -> np.ndarray:
        """The last line with the flag, up to each line of its file; or -1."""
        found = np.maximum.accumulate(np.where(flag, here, -1))
        return np.where(found >= begin, found, -1)

    def class_of(at: np.ndarray) -> np.ndarray:
        return np.where((at >= 0) & (kind[at] == _CLASS), name[at], _NONE)

    # a full name is a number: its class (or _NONE) times the number of words, and its word
    many = len(lines.words)
    named = (kind >= _DEF) & (name != _NONE)
    method = indented & (kind == _DEF)
    defined = (np.where(method, class_of(last(named & ~indented)), _NONE) * many + name)[named]
    own = np.where(indented, class_of(last((kind >= _DEF) & lines.at_margin[line])), _NONE)
    scope = last(named & (kind == _DEF))

    calling = np.flatnonzero((kind == _CALL) & (scope >= 0))
    of, at = _spread(lines.first[line[calling]], lines.count[line[calling]])
    above = scope[calling][of]
    owner, caller = own[above], own[above] * many + name[above]
    on, called, head = lines.object[at], lines.method[at], lines.head[at]
    importing = kind == _IMPORT
    origin = _imported(lines, file[importing], line[importing], file[calling][of] * many + head)
    bare, inner, foreign = on == _NONE, owner * many + called, origin >= 0
    owned = owner != _NONE
    target = np.select(
        [bare & (called == name[above]), bare & foreign, bare & lines.builtin[called], bare, np.isin(on, (_SELF, _CLS, _SUPER)) & owned, on == _SELF, foreign],
        [caller, origin, _BUILTINS * many + called, inner, inner, called, origin * many + lines.tail[at]],
        lines.callee[at],
    )
    found, which = np.unique(np.concatenate([defined, caller, target]), return_inverse=True)
    if not len(found):
        return None
    score = np.bincount(which, np.repeat([0.0, CALLER, CALLED], [len(defined), len(caller), len(target)]), len(found))
    here_too = np.zeros(len(found), bool)
    here_too[which[: len(defined)]] = True
    front, word = np.divmod(found, many)
    full = pc.binary_join_element_wise(lines.words.take(pa.array(front, mask=front == _NONE)), lines.words.take(pa.array(word)), ".", null_handling="skip")
    return pa.RecordBatch.from_arrays([full, pa.array(here_too), pa.array(score)], names=["full_name", "defined", "score"])


def scored_names(files: DataFrame, builtins: list[str]) -> DataFrame:
    """``name, full_name, score``: the full names that files define, with the scores of ``code.resolved_names``.

    A call's target and caller are known where its file is, so calls are never rows: a task adds up what many files say
    of a name, defined there or elsewhere, and names alone are shuffled. A name has no dot, so a full name tells it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).drop_null()
            step = max(1, len(texts) * BYTES // max(texts.nbytes, 1))
            for first in range(0, len(texts), step):
                if (told := _scores(texts[first : first + step], builtins)) is not None:
                    yield told

    some = files.select("text").mapInArrow(run, "full_name string, defined boolean, score double")
    whole = some.groupBy("full_name").agg(F.max("defined").alias("defined"), F.sum("score").alias("score")).where("defined")
    return whole.select(F.substring_index("full_name", ".", -1).alias("name"), "full_name", "score")
