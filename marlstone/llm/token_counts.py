"""Token counts under a unigram model, by dynamic programming over a trie (operator 1).

A token's probability follows from its rank in the vocabulary (Zipf: proportional to 1 / (rank + 1)), in whole
micro-nats so that sums are exact. Of the ways to write a pre-token in tokens, the most probable counts; of equal ones
the one with fewest tokens. A text's distinct pre-tokens go into a trie. A node holds the best score and token count of
the bytes up to it, so the forward step of a shared prefix is done once. Where a pre-token ends, the node stores how
often the text holds it; the text's totals are sums over these terminals.
"""

from __future__ import annotations

import base64
import math
from collections import Counter

from pyspark.sql import DataFrame

from marlstone.llm.byte_bpe import _JOINED
from marlstone.llm.common import held, over_texts

#: Trie nodes, and pieces of text whose terminals are known, that a task keeps at most; beyond that it starts anew, which
#: changes no result.
NODES, PIECES = 800_000, 300_000

#: Bytes of a pre-token that have nodes. Behind them only the last few scores are held, so that memory is bounded
#: however long a pre-token is.
DEPTH = 64


def zipf_scores(path: str) -> dict[bytes, int]:
    """Token to log-probability in micro-nats, from a rank file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: round(-1e6 * (math.log(r + 1) + total)) for t, r in ranks.items()}


class ForwardTrie:
    """Best segmentation of byte strings; nodes keep (score, tokens) of the path from the root."""

    def __init__(self, scores: dict[bytes, int], nodes: int = NODES, depth: int = DEPTH):
        self.scores, self.limit, self.depth = scores, nodes, depth
        self.longest = max(map(len, scores), default=1)
        # every ending of a token: going back from a byte, the first bytes that end no token end the search
        self.ends: dict[bytes, int | None] = {t[i:]: None for t in scores for i in range(1, len(t))} | scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.count = [0], [0]
        # by what stands before it, a piece of text and the terminals of its pre-tokens, one alone as it is
        self.known: dict[str, dict[str, int | list[int]]] = {"": {}, " ": {}}
        self.terminals: dict[int, int] = {}

    def _forward(self, word: bytes, i: int, best: list[int], count: list[int], at: list[int], behind: int) -> tuple[int, int]:
        """(score, tokens) of the first ``i`` bytes. Those of the first ``j`` are at ``at[j - behind]`` in the lists.

        A byte outside the vocabulary costs more than any token and counts as one.
        """
        last, ends = at[i - 1 - behind], self.ends
        top, n = best[last] - 50_000_000, count[last] + 1
        for j in range(i - 1, -1, -1):
            s = ends.get(word[j:i], False)
            if s is False:
                break
            if s is not None:
                node = at[j - behind]
                score, c = best[node] + s, count[node] + 1
                if score > top or score == top and c < n:
                    top, n = score, c
        return top, n

    def insert(self, word: bytes) -> tuple[int, tuple[int, int]]:
        """(terminal node, (0, 0)) of a pre-token; one that is too long to have a terminal gives -1 and its (score, tokens)."""
        children, best, count = self.children, self.best, self.count
        node, path = 0, [0]
        for i, byte in enumerate(word[: self.depth], 1):
            nxt = children.get(node << 8 | byte)
            if nxt is None:
                top, n = self._forward(word, i, best, count, path, 0)
                nxt = children[node << 8 | byte] = len(best)
                best.append(top)
                count.append(n)
            node = nxt
            path.append(node)
        if len(word) <= self.depth:
            return node, (0, 0)
        scores, tokens, behind = [best[x] for x in path], [count[x] for x in path], 0
        at = range(9 * self.longest + self.depth)
        for i in range(self.depth + 1, len(word) + 1):
            top, n = self._forward(word, i, scores, tokens, at, behind)
            scores.append(top)
            tokens.append(n)
            if len(scores) > 8 * self.longest:
                behind += len(scores) - self.longest
                del scores[: -self.longest], tokens[: -self.longest]
        return -1, (scores[-1], tokens[-1])

    def add(self, piece: str, times: int, split) -> tuple[list[int], int, int]:
        """Count the pre-tokens of a piece of text ``times`` at their terminals: these (-1: none), and the (score,
        tokens) of those without one."""
        nodes, score, tokens = [], 0, 0
        for w in split(piece):
            node, (s, n) = self.insert(w.encode())
            nodes.append(node)
            score, tokens = score + s, tokens + n
            if node >= 0:
                self.terminals[node] = self.terminals.get(node, 0) + times
        return nodes, times * score, times * tokens

    def totals(self, text: str, split) -> tuple[int, int, int]:
        """(pre-tokens, score, tokens) of a whole text. Where single spaces part words, distinct ones are split once."""
        if not text:
            return 0, 0, 0
        held = score = tokens = 0
        if "  " in text or text[-1] == " " or _JOINED.search(text):
            pieces, space = Counter(split.findall(text)), ""
        else:
            first, *rest = text.split(" ")
            pieces, space = Counter(rest), " "
            nodes, score, tokens = self.add(first, 1, split.findall)
            held = len(nodes)
        known = self.known[space]
        for piece, times in pieces.items():
            nodes = known.get(piece)
            if nodes is None:
                if len(self.best) > self.limit or len(known) > PIECES:
                    s, n = self.collect()
                    score, tokens = score + s, tokens + n
                    self.clear()
                    known = self.known[space]
                nodes, s, n = self.add(space + piece, times, split.findall)
                held, score, tokens = held + times * len(nodes), score + s, tokens + n
                if -1 not in nodes:
                    known[piece] = nodes[0] if len(nodes) == 1 else nodes
                continue
            terminals = self.terminals
            if nodes.__class__ is int:  # nearly all pieces are one pre-token
                held += times
                terminals[nodes] = terminals.get(nodes, 0) + times
                continue
            held += times * len(nodes)
            for node in nodes:
                terminals[node] = terminals.get(node, 0) + times
        s, n = self.collect()
        return held, score + s, tokens + n

    def collect(self) -> tuple[int, int]:
        """(score, tokens) over the terminals, whose counts are then gone."""
        best, count = self.best, self.count
        out = sum(k * best[t] for t, k in self.terminals.items()), sum(k * count[t] for t, k in self.terminals.items())
        self.terminals.clear()
        return out


def token_counts(docs: DataFrame, *, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_pretokens, n_tokens, score`` of every whole text; ``score`` is its log-probability in nats.

    Each task has its own trie, of bounded size, so nothing is shuffled and a lost task is done again alone. Null and
    empty texts have zeros; a table without rows gives none. One row for each input row, repeated ones too; other
    columns are not read.
    """

    def make():
        import regex

        trie = held(("unigram", path, pattern), lambda: ForwardTrie(zipf_scores(path)))
        split = regex.compile(pattern)

        def one(x: str):
            pretokens, score, tokens = trie.totals(x, split)
            return pretokens, tokens, score / 1e6

        return lambda texts: [one(x) for x in texts]

    return over_texts(docs, make, "n_pretokens bigint, n_tokens bigint, score double", key=key, text=text)
