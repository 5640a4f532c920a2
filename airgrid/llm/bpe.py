"""Byte-level BPE encoding and decoding with DuckDB's recursive queries inside Spark's partitions.

Texts are cut at every change from a visible character to white space; such a chunk holds whole matches of the pattern, so
equal chunks have equal tokens. Words (matches) that a task hasn't met yet become token-position rows in DuckDB, one row per byte.
A recursive query joins neighbouring rows with the merge table, takes each word's pair of the least rank and contracts its leftmost
occurrence. In words over ``LONG`` bytes a step also contracts all pairs that no other contraction can forestall, and only a bounded number of
rounds is kept (``ROWS_AT_ONCE``), so that neither long runs nor long unbroken words add up. It ends when no word has a pair left. A word that is
a token itself is that token. Decoding joins id rows with the vocabulary and aggregates the bytes in order.

The vocabulary (under 1 MB) is read on the driver and broadcast; a task keeps at most about ``KNOWN`` chunks and words.

Defined results: a null text is empty: no tokens, and the hashes of nothing; ids and repeated rows are returned as they are; an empty
table gives no rows; other columns are ignored by ``encode``, and ``decode`` gives null for a null list.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.common import slices, utf8_texts

KNOWN = 500_000
RANGE = 1 << 19    # tokens decoded by one query
AT_ONCE = 1 << 20  # bytes of text encoded at once; a worker keeps what DuckDB and Python took for them
PORTION = 4 << 20  # characters of a text whose chunks are held at once
WORDS_AT_ONCE, LONG = 20_000, 64
#: Rows that the rounds of one query hold together.
ROWS_AT_ONCE = 2_000_000
#: Rounds after which the borders of long words are looked at again.
ROUNDS = 8
#: White space as the pattern's \s has it: the Unicode property.
_WHITE = r"\t-\r \x85\xa0  -     　"
_CHUNK = f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+"

#: For words of up to LONG bytes: rows know their next position j and its token u, so a step needs no sort.
ENCODE = """
WITH RECURSIVE step AS (
  SELECT w, i, t, j, u, 0 AS round FROM start
  UNION ALL
  SELECT s.w, s.i, CASE WHEN s.i = b.i THEN b.c ELSE s.t END, CASE WHEN s.i = b.i THEN r.j ELSE s.j END,
         CASE WHEN s.i = b.i THEN r.u WHEN s.j = b.i THEN b.c ELSE s.u END, s.round + 1
  FROM step s
  JOIN (SELECT w, (best >> 32)::INT AS c, ((best >> 16) & 65535)::INT AS i, (best & 65535)::INT AS j
        FROM (SELECT p.w, min((m.c::BIGINT << 32) | (p.i << 16) | p.j) AS best FROM step p JOIN merges m ON m.a = p.t AND m.b = p.u GROUP BY p.w)) b
    ON s.w = b.w
  JOIN step r ON r.w = b.w AND r.i = b.j
  WHERE s.i <> b.j)
SELECT w, i, t FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round) ORDER BY w, i
"""
#: For longer words: a step contracts every pair that nothing can forestall. ``low`` is the least rank of a token that the word has across
#: the border behind the row, so no contraction across it has a lower rank. A pair is free if both neighbouring borders have a greater one than its
#: own rank; so is a run of equal ranks between such borders, every other one from the left, if no lower rank lies inside. Besides, the least
#: pair is contracted: all its occurrences if that can't bring up a lower rank, else the leftmost. At most {rounds} rounds are kept.
ENCODE_LONG = """
WITH RECURSIVE step AS (
  SELECT w, i, t, low, 0 AS round FROM start
  UNION ALL
  SELECT w, i, t, low, round FROM (
    WITH pairs AS (
      SELECT s.w, s.i, s.t, s.low, s.next_low, s.round, m.c, m.alone, s.last_low
      FROM (SELECT *, lead(t) OVER o AS n, coalesce(lead(low) OVER o, 1 << 30) AS next_low, coalesce(lag(low) OVER o, 1 << 30) AS last_low
            FROM step WHERE round < {rounds} WINDOW o AS (PARTITION BY w ORDER BY i)) s
      LEFT JOIN merges m ON m.a = s.t AND m.b = s.n),
    near AS (SELECT *, min(c) OVER (PARTITION BY w) AS best,
                    (c IS NOT DISTINCT FROM lag(c) OVER o OR last_low > c) AND (c IS NOT DISTINCT FROM lead(c) OVER o OR next_low > c) AND (low = c OR (last_low > c AND next_low > c)) AS apart
             FROM pairs WINDOW o AS (PARTITION BY w ORDER BY i)),
    nth AS (SELECT *, row_number() OVER (PARTITION BY w, c ORDER BY i) AS k FROM near WHERE best IS NOT NULL),
    runs AS (SELECT *, row_number() OVER (PARTITION BY w, c, i - k ORDER BY i) % 2 AS odd, bool_and(apart) OVER (PARTITION BY w, c, i - k) AS free FROM nth),
    spot AS (SELECT *, CASE WHEN c IS NULL THEN 0 WHEN free THEN odd WHEN c > best THEN 0 WHEN alone THEN CAST(k = 1 AS INT) ELSE odd END AS taken FROM runs),
    joined AS (SELECT *, lag(taken) OVER o AS gone, row_number() OVER o AS place FROM spot WINDOW o AS (PARTITION BY w ORDER BY i))
    SELECT w, (row_number() OVER (PARTITION BY w ORDER BY place) - 1)::INT AS i, CASE WHEN taken = 1 THEN c ELSE t END AS t,
           (CASE WHEN taken = 1 THEN next_low ELSE low END)::INT AS low, round + 1 AS round
    FROM joined WHERE coalesce(gone, 0) = 0))
SELECT w, i, t, last FROM (SELECT w, i, t, round, max(round) OVER (PARTITION BY w) AS last FROM step) WHERE round = last ORDER BY w, i
"""
DECODE = "SELECT d, string_agg(v.bytes, '' ORDER BY p) AS bytes FROM ids JOIN vocabulary v ON v.id = ids.t GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """a, b, c: neighbouring tokens a and b make c, whose rank is c. ``alone``: a token that starts or ends with c and whose
    other part is a token has a lower rank, so that occurrences of this pair must be contracted one by one."""
    a, b, c = [], [], []
    alone = set()
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                a.append(left), b.append(right), c.append(rank)
                alone |= {x for x in (left, right) if x > rank}
    return pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "c": pa.array(c, pa.int32()), "alone": pa.array([x in alone for x in c])})


class Codec:
    """One task's DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        self.ranks, self.words, self.chunks = ranks, regex.compile(pattern), re.compile(_CHUNK)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("given", merge_table(ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([k.decode("latin-1") for k in ranks])})
        self.db.register("names", names)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM names")
        self.starts: set[bytes] = set()  # of the tokens, made for the first long word
        self.single = np.array([ranks[bytes([k])] for k in range(256)], np.int32)
        self.known: dict[str, bytes] = {}  # chunks
        self.met: dict[bytes, bytes] = {}  # words that aren't tokens

    def word_ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids (32 bits, little endian) of each word; words that are tokens need no query."""
        out = {w: self.ranks[w].to_bytes(4, "little") for w in words if w in self.ranks}
        out |= {w: self.met[w] for w in words if w in self.met}
        if len(self.met) > KNOWN:
            self.met.clear()
        short = self._merged([w for w in words if w not in out and len(w) <= LONG], False)
        self.met |= short
        return out | short | self._merged([w for w in words if w not in out and len(w) > LONG], True)

    def _merged(self, rest: list[bytes], long: bool) -> dict[bytes, bytes]:
        out: dict[bytes, bytes] = {}
        at = 0
        while at < len(rest):
            part, held, rows = [], 0, 0
            while at < len(rest) and len(part) < WORDS_AT_ONCE:
                n = len(rest[at])
                rows += n * (n + 1) // 2  # a round contracts a pair of a short word at least; _rounds bounds those of long words
                if part and (held + n >= 400_000 or not long and rows > ROWS_AT_ONCE):
                    break
                held += n
                part.append(rest[at])
                at += 1
            lengths = np.array([len(w) for w in part])
            first = np.cumsum(lengths) - lengths
            of_word = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            place, token = np.arange(held) - np.repeat(first, lengths), self.single[np.frombuffer(b"".join(part), np.uint8)]
            if long:
                of, ids = self._rounds(of_word, place.astype(np.int32), token)
            else:
                end = np.append(of_word[1:] != of_word[:-1], True)  # of a word: there is no next token
                start = pa.table({"w": of_word, "i": place.astype(np.int32), "t": token, "j": np.where(end, -1, place + 1).astype(np.int32),
                                  "u": np.where(end, -1, np.append(token[1:], -1)).astype(np.int32)})
                got = self._query(ENCODE, start)
                of, ids = got["w"].to_numpy(), got["t"].to_numpy()
            cuts = np.searchsorted(of, np.arange(len(part) + 1))
            data = ids.astype("<u4").tobytes()
            out |= {w: data[4 * cuts[k]:4 * cuts[k + 1]] for k, w in enumerate(part)}
        return out

    def _query(self, query: str, start: pa.Table) -> pa.Table:
        self.db.register("start", start)
        got = self.db.sql(query).to_arrow_table()
        self.db.unregister("start")
        return got

    def _borders(self, of_word: np.ndarray, token: np.ndarray) -> np.ndarray:
        """For the border behind each row, the least rank of a token across it that starts and ends where rows do."""
        if not self.starts:
            self.starts = {t[:k] for t in self.ranks for k in range(1, len(t) + 1)}
            self.token = {i: t for t, i in self.ranks.items()}
        parts = [self.token[t] for t in token.tolist()]
        found: dict[int, tuple[list[int], list[int]]] = {}
        ends = np.append(np.flatnonzero(of_word[1:] != of_word[:-1]) + 1, len(of_word))[np.cumsum(np.append(0, of_word[1:] != of_word[:-1]))].tolist()
        for at, end in enumerate(ends):
            text = parts[at]
            for k in range(at + 1, end):
                text += parts[k]
                if text not in self.starts:
                    break
                rank = self.ranks.get(text)
                if rank is not None:
                    first, ranks = found.setdefault(k - at, ([], []))
                    first.append(at)
                    ranks.append(rank)
        low = np.full(len(token), 1 << 30, np.int32)
        for borders, (first, ranks) in found.items():
            for k in range(borders):
                spot = np.array(first) + k
                low[spot] = np.minimum(low[spot], ranks)
        return low

    def _rounds(self, of_word: np.ndarray, place: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word and id of each token of long words: a bounded number of rounds in a query, whose newest round the next query starts from."""
        ended = []
        while len(of_word):
            rounds = min(ROUNDS, max(1, ROWS_AT_ONCE // len(of_word) - 1))
            got = self._query(ENCODE_LONG.format(rounds=rounds), pa.table({"w": of_word, "i": place, "t": token, "low": self._borders(of_word, token)}))
            of_word, place, token, more = got["w"].to_numpy(), got["i"].to_numpy(), got["t"].to_numpy(), got["last"].to_numpy() == rounds
            ended.append((of_word[~more], token[~more]))
            of_word, place, token = of_word[more], place[more], token[more]
        of, ids = (np.concatenate(x) for x in zip(*ended, strict=True))
        order = np.argsort(of, kind="stable")
        return of[order], ids[order]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers; a long text's words are taken in portions."""
        if sum(map(len, texts)) <= PORTION:
            return self._encoded([self.chunks.findall(t) for t in texts])
        out = []
        for text in texts:
            chunks = (m.group() for m in self.chunks.finditer(text))
            out.append(b"".join(self._encoded([part])[0] for part in iter(lambda c=chunks: list(itertools.islice(c, PORTION // 8)), [])))
        return out

    def _encoded(self, chunked: list[list[str]]) -> list[bytes]:
        if len(self.known) > KNOWN:
            self.known.clear()
        found = [list(map(self.known.get, chunks)) for chunks in chunked]
        fresh = list({c for chunks, got in zip(chunked, found, strict=True) for c, g in zip(chunks, got, strict=True) if g is None})
        parts = [[w.encode() for w in self.words.findall(c)] for c in fresh]
        ids = self.word_ids(list(dict.fromkeys(w for p in parts for w in p)))
        new = {c: b"".join(map(ids.__getitem__, p)) for c, p in zip(fresh, parts, strict=True)}
        self.known |= new
        return [b"".join([g if g is not None else new[c] for c, g in zip(chunks, got, strict=True)]) for chunks, got in zip(chunked, found, strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids, worked out in ranges of at most RANGE tokens: the ordered aggregate of a range fits in memory."""
        out: list[list[bytes]] = [[] for _ in ids]
        held: list[tuple[int, bytes]] = []
        size = 0
        for d, x in enumerate(ids):
            for at in range(0, len(x), 4 * RANGE):
                held.append((d, x[at:at + 4 * RANGE]))
                size += len(held[-1][1])
                if size >= 4 * RANGE:
                    self._decoded(held, out)
                    held, size = [], 0
        if held:
            self._decoded(held, out)
        return [b"".join(x) for x in out]

    def _decoded(self, held: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        lengths = np.array([len(x) // 4 for _, x in held], np.int64)
        rows = pa.table({"d": np.repeat(np.arange(len(held), dtype=np.int32), lengths), "p": np.arange(int(lengths.sum()), dtype=np.int64),
                         "t": np.frombuffer(b"".join(x for _, x in held), "<u4").astype(np.int32)})
        self.db.register("ids", rows)
        for k, text in self.db.sql(DECODE).fetchall():
            out[held[k][0]].append(text.encode("latin-1"))
        self.db.unregister("ids")


_CODECS: dict[str, Codec] = {}


def _codec(name: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """This Python worker's codec of that name; tasks that follow each other in a worker share what it has met."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def _name(ranks: dict[bytes, int], pattern: str) -> str:
    return hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()


def _over(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: tuple[str, ...], schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    name = _name(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", AT_ONCE):
            yield make(_codec(name, shared.value, pattern), part)

    return docs.select(*keep).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and ids (array of bigint) of every whole text."""

    def make(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        found = codec.encode([t.decode() for t in utf8_texts(part.column("text"))])
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int64)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return _over(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ranks, pattern, ("doc_id", "text"), "doc_id bigint, ids array<bigint>", make)


def decode(encoded: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every list of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    name = _name(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codec = _codec(name, shared.value, pattern)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column("ids").to_pylist()
                got = codec.decode([b"" if x is None else np.array(x, "<u4").tobytes() for x in lists])
                got = [None if x is None else b for x, b in zip(lists, got, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, contents: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, and with ``contents`` the ids (array of int) and the decoded text:
    encoded and decoded in one pass over the texts."""

    def make(codec: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.encode([t.decode() for t in utf8_texts(part.column("text"))])
        back = codec.decode(ids)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(sizes), "ids_sha256": sha(ids), "decoded_sha256": sha(back)}
        if contents:
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            columns["text"] = pa.array([x.decode() for x in back], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, text string" if contents else "")
    return _over(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), ranks, pattern, ("doc_id", "text"), schema, make)
