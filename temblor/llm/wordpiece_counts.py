"""Operator 7, token counts: greedy longest-match word pieces counted in linear time.

The vocabulary becomes a trie with failure links.  Each node knows how many pieces
its failure transition pops, so a word's greedy length falls out of one pass over its
characters and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.llm.common import small_batches, text_runs

MEMO_BYTES = 32_000_000


class CountingAutomaton:
    """Trie over word-initial pieces and continuation pieces.

    ``initial`` are pieces that may start a word, ``inner`` those that may continue
    one.  A word that no greedy split covers counts as one unknown token.
    """

    def __init__(self, initial: list[str], inner: list[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        self.final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    nxt = self.child[node].get(c)
                    if nxt is None:
                        nxt = self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.final.append(False)
                    node = nxt
                self.final[node] = node > 1
        self._link()

    def _link(self) -> None:
        """Failure node and popped-piece count of every node, breadth first.

        For a node whose string is itself a piece, failing pops that piece and goes on
        from the continuation root; otherwise it pops what its parent pops and follows
        the parent's failure chain until the last character can be read there.
        """
        self.fail = [-1] * len(self.child)
        self.pops = [0] * len(self.child)
        queue = deque((0, 1))
        while queue:
            parent = queue.popleft()
            for c, node in self.child[parent].items():
                queue.append(node)
                if self.final[node]:
                    self.fail[node], self.pops[node] = 1, 1
                    continue
                at, popped = self.fail[parent], self.pops[parent]
                while at != -1 and c not in self.child[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at != -1:
                    self.fail[node], self.pops[node] = self.child[at][c], popped

    def count(self, word: str) -> int:
        """Number of greedy pieces of a word; 1 (unknown) when it can't be covered, 0 for an empty one."""
        if not word:
            return 0
        node, total, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for c in word:
            while (nxt := child[node].get(c)) is None:
                if fail[node] == -1:
                    return 1
                total += pops[node]
                node = fail[node]
            node = nxt
        while node != 1:
            if fail[node] == -1:
                return 1
            total += pops[node]
            node = fail[node]
        return total


def pieces_of_model(path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuation pieces of a SentencePiece model file's vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    mark = "▁"
    initial = [n[1:] for n in names if n.startswith(mark) and len(n) > 1 and mark not in n[1:]]
    return initial, [n for n in names if mark not in n]


def token_counts(docs: DataFrame, initial: list[str], inner: list[str], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every whole text; words are split at white space.

    Null and empty texts have 0 words and 0 tokens.  One row per input row, repeated
    and null ids included; other columns play no part; an empty table gives an empty
    result.  A word of any length is one pass over its characters; words met are kept
    up to MEMO_BYTES and the words of one run of texts.
    """
    small_batches(docs.sparkSession)
    machine = CountingAutomaton(initial, inner)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # as large as the vocabulary

    @F.arrow_udf("struct<words:bigint,tokens:bigint>")
    def counted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = shared.value.count
        memo, size = {}, 0  # live as long as the task
        for column in columns:
            words, totals = [], []
            for _, texts in text_runs(column, 500_000):
                if size > MEMO_BYTES:
                    memo, size = {}, 0
                for text in texts:
                    parts = text.split() if text else []
                    words.append(len(parts))
                    for w in set(parts):
                        if w not in memo:
                            memo[w] = count(w)
                            size += getsizeof(w) + 100
                    totals.append(sum(map(memo.__getitem__, parts)))
            yield pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(totals, pa.int64())], ["words", "tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), counted(F.col(text_col)).alias("c")).select("doc_id", F.col("c.words").alias("n_words"), F.col("c.tokens").alias("n_tokens"))
