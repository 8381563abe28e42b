"""Token counts under a unigram vocabulary, with one forward score per shared prefix.

The distinct pre-tokens of a task go into a trie. Each new node gets the best forward score
of its prefix and that path's number of tokens, from the scores of the nodes above it, so
a prefix that many words share is scored once; a word's terminal node holds its count.
New words wait until there are many and go in sorted, each from where it parts from the last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..tables import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A task's trie is started anew beyond this many nodes, which bounds its memory.
TRIE_NODES = 800_000
#: New pre-tokens wait until there are this many, and go into the trie sorted.
WAITING = 400_000
#: Longer pre-tokens are scored in a window of the longest piece and leave no nodes.
LONG = 1_000
#: As many last characters say which lengths a piece can have.
SUFFIX = 4
_PRETOKEN = re.compile(r"\n|▁*[^▁\n]+|▁+")


def load_vocabulary(path: str) -> tuple[dict[str, float], float]:
    """Pieces with their scores, and the score of an unknown character (10 below the least)."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    pieces = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
    return pieces, min(pieces.values()) - 10.0


class Trie:
    """Pre-tokens by prefix; node 0 is the empty prefix."""

    def __init__(self, pieces: dict[str, float], unknown: float, nodes: int = TRIE_NODES) -> None:
        self.pieces, self.unknown, self.limit = pieces, unknown, nodes
        self.longest = max(map(len, pieces), default=1)
        ends: dict[str, set[int]] = {piece[-SUFFIX:]: set() for piece in pieces}
        for piece in pieces:
            ends[piece[-SUFFIX:]].add(len(piece))
        for end, found in ends.items():
            found.update(k for k in range(1, len(end)) if end[-k:] in pieces)
        #: Lengths, longest first, of the pieces that text with these last characters can end with.
        self.ends = {end: tuple(sorted(found, reverse=True)) for end, found in ends.items()}
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # by node and character
        self.score, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}
        self.last, self.path = "", [0]  # the word inserted last, and its nodes

    def _lengths(self, word: str, end: int) -> tuple[int, ...]:
        """Lengths that a piece which ends at ``end`` can have, longest first; they may reach before the word."""
        for start in range(max(0, end - SUFFIX), end):
            found = self.ends.get(word[start:end])
            if found is not None:
                return found
        return ()

    def insert(self, word: str) -> int:
        """The number of tokens of ``word``; scores only the prefixes that are new, and starts where it parts from the word before, so sorted words are fast."""
        if len(word) > LONG:
            return self._rolled(word)
        if len(self.score) > self.limit:
            self.clear()
        path, child, same = self.path, self.child.get, 0
        for one, other in zip(word, self.last):
            if one != other:
                break
            same += 1
        del path[same + 1 :]
        node = path[same]
        for end in range(same + 1, len(word) + 1):
            step = ord(word[end - 1]) << 40 | node  # the node in the low bits, by which a dict spreads its keys
            found = child(step)
            if found is None:
                found = self.child[step] = len(self.score)
                self._forward(word, end, path)
            node = found
            path.append(node)
        self.last = word
        count = self.terminal[word] = self.tokens[node]
        return count

    def _rolled(self, word: str) -> int:
        """As :meth:`insert`, with the scores of the last few prefixes only."""
        keep, pieces = self.longest, self.pieces
        scores, tokens = [0.0], [0]
        for end in range(1, len(word) + 1):
            best, count = float("-inf"), 0
            for back in self._lengths(word, end):
                if back <= end and (score := pieces.get(word[end - back : end])) is not None and (total := scores[-back] + score) > best:
                    best, count = total, tokens[-back] + 1
            if word[end - 1] not in pieces and (total := scores[-1] + self.unknown) > best:
                best, count = total, tokens[-1] + len(word[end - 1].encode("utf-8", "surrogatepass"))
            scores.append(best)
            tokens.append(count)
            if len(scores) > 64 * keep:
                del scores[:-keep], tokens[:-keep]
        return tokens[-1]

    def _forward(self, word: str, end: int, path: list[int]) -> None:
        """Scores the prefix of ``end`` characters; equal scores keep the longest last piece."""
        best, count = float("-inf"), 0
        pieces, scores, tokens = self.pieces, self.score, self.tokens
        for back in self._lengths(word, end):
            if back <= end and (score := pieces.get(word[end - back : end])) is not None and (total := scores[path[end - back]] + score) > best:
                best, count = total, tokens[path[end - back]] + 1
        if word[end - 1] not in pieces and (total := scores[path[end - 1]] + self.unknown) > best:
            best, count = total, tokens[path[end - 1]] + len(word[end - 1].encode("utf-8", "surrogatepass"))
        self.score.append(best)
        self.tokens.append(count)


def pretokens(text: str | None) -> list[str]:
    """Spaces become ``▁``, one more stands before the text; breaks come before each run of them and around line ends, where no piece reaches across."""
    return _PRETOKEN.findall("▁" + text.replace(" ", "▁")) if text else []


def _settle(trie: Trie, tokens: list[int], waiting: list[tuple[int, list[str]]]) -> None:
    """Adds the tokens of the new pre-tokens of rows to ``tokens``; they go into the trie in order."""
    found = {word: trie.insert(word) for word in sorted({word for _, new in waiting for word in new})}
    for row, new in waiting:
        tokens[row] += sum(map(found.__getitem__, new))


def _count(frames: Iterator[pd.DataFrame], path: str, text: str) -> Iterator[pd.DataFrame]:
    trie = Trie(*load_vocabulary(path))
    for frame in frames:
        tokens, words, waiting, n = [], [], [], 0
        for t in frame[text]:
            parts = pretokens(t)
            counts = list(map(trie.terminal.get, parts))
            if None in counts:
                new = [word for word, count in zip(parts, counts) if count is None]
                waiting.append((len(tokens), new))
                counts, n = [count for count in counts if count is not None], n + len(new)
            tokens.append(sum(counts))
            words.append(len(parts))
            if n > WAITING:
                _settle(trie, tokens, waiting)
                waiting, n = [], 0
        _settle(trie, tokens, waiting)
        yield frame.drop(columns=[text]).assign(n_tokens=tokens, n_pretokens=words)


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` and ``n_pretokens``.

    ``vocabulary`` is a piece file that every executor can open; its scores are read as
    unigram scores. A character without a piece counts its UTF-8 bytes. Null and empty texts
    have 0 tokens. Other columns pass through, but for those with the two result names, which
    are replaced; repeated rows stay, an empty table gives an empty result. No shuffle.
    """
    docs = docs.drop("n_tokens", "n_pretokens")
    schema = T.StructType([f for f in docs.schema.fields if f.name != text]).add("n_tokens", "long").add("n_pretokens", "long")
    return docs.mapInPandas(partial(_count, path=vocabulary, text=text), schema)


def op10_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n_tokens"), F.col("n_pretokens"))
