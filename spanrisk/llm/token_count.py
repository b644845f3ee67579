"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word (`[^\\x20\\x09-\\x0D]+`) behind the marker U+2581. Each task inserts the distinct pre-tokens that it
meets in a trie. A node stands for a prefix and keeps the best unigram (Viterbi) forward score of that prefix and the
number of tokens on that path, so a prefix that many words share is scored once; a word's last node gives its count,
and a document's count is the sum over its words. No shuffle: the texts stay where they are read, and the trie is
started anew when it exceeds ``max_nodes``, which bounds memory and changes no result.

The vocabulary is a public model's pieces (never trained here); the file holds merge ranks, so a piece's log-probability
follows Zipf's law over its rank. A character in no piece falls back to its UTF-8 bytes, a token each.
Equal scores: fewer tokens win. Null and empty texts have no tokens; repeated rows count alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanrisk.llm.common import with_text_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE_PENALTY = 10.0  # of a fallback byte, below the rarest piece
MAX_NODES = 400_000  # of one task's trie, some 80 MB

FIELDS = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]


@dataclass(frozen=True)
class Vocabulary:
    score: dict[str, float]
    byte_score: float
    longest: dict[str, int]  # length of the longest piece by its last character


def vocabulary(scores: dict[str, float]) -> Vocabulary:
    longest: dict[str, int] = {}
    for piece in scores:
        longest[piece[-1]] = max(longest.get(piece[-1], 0), len(piece))
    return Vocabulary(scores, min(scores.values(), default=0.0) - BYTE_PENALTY, longest)


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces of a SentencePiece file, without its control, unknown and byte pieces (some 32,000, read on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size())
           if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / r for r in range(1, len(ids) + 1)))
    return vocabulary({model.id_to_piece(i): -math.log(r) - total for r, i in enumerate(ids, 1)})


class CountingTrie(dict):
    """Word (bytes) -> number of tokens; a missing word is inserted in the trie."""

    def __init__(self, vocab: Vocabulary, max_nodes: int = MAX_NODES) -> None:
        super().__init__()
        self.vocab, self.max_nodes, self.scored = vocab, max_nodes, 0
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]

    def __missing__(self, word: bytes) -> int:
        if len(self.best) > self.max_nodes:
            self._reset()
        s = MARK + word.decode("utf-8", "surrogatepass")
        child, best, tokens, score = self.child, self.best, self.tokens, self.vocab.score
        node, path = 0, [0]
        for i, ch in enumerate(s, 1):
            edge = node << 21 | ord(ch)
            node = child.get(edge, 0)
            if not node:
                size = len(ch.encode("utf-8", "surrogatepass"))
                top, count = best[path[-1]] + size * self.vocab.byte_score, tokens[path[-1]] + size
                for j in range(max(0, i - self.vocab.longest.get(ch, 0)), i):
                    lp = score.get(s[j:i])
                    if lp is not None:
                        lp += best[path[j]]
                        n = tokens[path[j]] + 1
                        if lp > top or lp == top and n < count:
                            top, count = lp, n
                node = child[edge] = len(best)
                best.append(top)
                tokens.append(count)
                self.scored += 1
            path.append(node)
        self[word] = tokens[node]
        return tokens[node]


def count_tokens(docs: DataFrame, text: str = "text", path: str = VOCABULARY,
                 max_nodes: int = MAX_NODES) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens."""
    held = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def make():
        trie = CountingTrie(held.value, max_nodes)

        def step(texts: list[bytes]) -> dict[str, list[int]]:
            words = [t.split() for t in texts]
            return {"n_pretokens": [len(w) for w in words], "n_tokens": [sum(map(trie.__getitem__, w)) for w in words]}

        return step

    return with_text_columns(docs, text, FIELDS, make)
