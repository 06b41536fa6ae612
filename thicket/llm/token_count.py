"""Token counts by a linear longest-match automaton: a trie of the vocabulary with failure links and precomputed
counts of popped tokens gives greedy word-piece lengths without building the pieces."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import lean, table, utf8

#: Default place of the vocabulary; never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words of at most this many bytes are remembered, and at most this many of them.
REMEMBERED_BYTES, REMEMBERED_WORDS = 48, 400_000


def load_ranks(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a rank file, one base64 piece and its rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Greedy longest-match over byte pieces.

    With `mark`, pieces that begin with it start a word and the others continue one, as in word-piece
    vocabularies: a word is matched with the mark put before it.  Without it every piece may stand anywhere.
    A word that can't be covered counts `unknown` tokens.

    Each node of the trie has a failure link and the number of tokens popped on the way to it: when no edge goes
    on, the longest pieces that cover the node's string are popped, and the link is the node of what is left.
    A word takes time linear in its length.
    """

    def __init__(self, pieces: Iterable[bytes], mark: bytes = b"", unknown: int = 1) -> None:
        self.mark, self.unknown = mark, unknown
        edges: list[dict[int, int]] = [{}]
        token = [False]
        for piece in pieces:
            node = 0
            for c in piece:
                to = edges[node].get(c)
                if to is None:
                    to = len(edges)
                    edges[node][c] = to
                    edges.append({})
                    token.append(False)
                node = to
            token[node] = node != 0
        link, popped = [-1] * len(edges), [0] * len(edges)  # link -1: no piece covers the node's string
        queue = deque()
        for node in edges[0].values():
            link[node], popped[node] = (0, 1) if token[node] else (-1, 0)
            queue.append(node)
        while queue:
            above = queue.popleft()
            for c, node in edges[above].items():
                queue.append(node)
                if token[node]:
                    link[node], popped[node] = 0, 1
                    continue
                at, n = link[above], popped[above]
                while at != -1 and c not in edges[at]:
                    n += popped[at]
                    at = link[at] if at else -1
                if at != -1:
                    link[node], popped[node] = edges[at][c], n
        self.edges, self.link, self.popped = edges, link, popped

    def length(self, word: bytes) -> int:
        """Tokens of one word."""
        edges, link, popped = self.edges, self.link, self.popped
        node, n = 0, 0
        for c in self.mark + word:
            to = edges[node].get(c)
            while to is None:
                if node == 0 or link[node] == -1:
                    return self.unknown
                n += popped[node]
                node = link[node]
                to = edges[node].get(c)
            node = to
        while node:
            if link[node] == -1:
                return self.unknown
            n += popped[node]
            node = link[node]
        return n


class Lengths(dict):
    """Tokens by word, filled as words come; never larger than REMEMBERED_WORDS."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.length(word)
        if len(word) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = n
        return n


SCHEMA = "doc_id long, n_bytes long, n_words long, n_tokens long, most_in_word long"


def count_tokens(docs: DataFrame, pieces: list[bytes], mark: bytes = b" ", text: str = "text") -> DataFrame:
    """Bytes, white-space words, tokens and the most tokens of one word, of every whole text.

    Words are maximal runs without ASCII white space.  Null and empty texts count 0 of all.  Repeated rows give
    repeated results; columns other than doc_id and the text are not read.  The vocabulary has a fixed size and
    is sent to the tasks once.
    """
    lean(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(b"\n".join(base64.b64encode(p) for p in pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(_automaton(shipped, mark))
        for batch in batches:
            n_bytes, n_words, n_tokens, most = [], [], [], []
            for raw in utf8(batch.column(1)):
                counts = list(map(lengths.__getitem__, raw.split())) if raw else []
                n_bytes.append(len(raw or b""))
                n_words.append(len(counts))
                n_tokens.append(sum(counts))
                most.append(max(counts, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_words, n_tokens, most))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)


_built: dict[tuple[int, bytes], Automaton] = {}


def _automaton(shipped, mark: bytes) -> Automaton:
    """Built once for each worker process and broadcast."""
    key = (hash(shipped.value), mark)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(map(base64.b64decode, shipped.value.split(b"\n")), mark)
    return _built[key]


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_ranks())
