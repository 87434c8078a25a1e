"""Token counts by batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, where no token of the vocabulary can span the
cut, and the pieces of all texts of an Arrow batch are encoded in batches of about equal
bytes, whatever texts they come from. Only lengths leave the worker. Safe boundaries of a
SentencePiece BPE model with word marks:

- a space between two characters that are not spaces: every piece of the vocabulary
  holds the mark only in front, and the space becomes the mark that the encoder
  puts before a fresh text anyway;
- the front of a line break: no piece but the byte piece holds a line break. A piece
  that starts with one gets a mark from the encoder that is not in the text; the
  count leaves it out;
- in a long run without spaces, between two characters that follow each other in no piece of
  the vocabulary: no merge can cross them. The rest is encoded behind a line
  break, so that no mark joins it, and the break and its mark are left out.

Pieces that come back (most words do) are counted once per worker process: a
memo holds the lengths of short ones, bounded by their bytes. The result never depends on it.

Scale: no shuffle and no state between rows; input splits are cut by bytes, a
worker holds one Arrow batch, the model and the memo.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import read_table
from tidebook.runtime import ship_package

MODEL, TOKEN_LIMIT = "piece_bpe_32k.model", 4096
#: UTF-8 bytes of pieces in one call of the encoder, of texts that are looked up together, and of each of the memo's two generations.
BATCH_BYTES, GROUP_BYTES, MEMO_BYTES = 1 << 20, 1 << 22, 1 << 24
#: Bytes of the longest piece that the memo keeps, characters from which a piece is cut, pieces of a text that are looked up together.
KEPT_BYTES, LONG, SLICE = 64, 2048, 20_000


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Counts tokens of whole texts with one SentencePiece model."""

    def __init__(self, path: str, batch_bytes: int = BATCH_BYTES, memo_bytes: int = MEMO_BYTES, long: int = LONG):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        self.batch_bytes, self.memo_bytes, self.long = batch_bytes, memo_bytes, long
        self.young: dict[str, int] = {"": 0}
        self.old: dict[str, int] = {}
        self.young_bytes = 0
        self.neighbours: set[tuple[str, str]] = set()
        special = (self.encoder.is_byte, self.encoder.is_control, self.encoder.is_unknown)
        for k in range(self.encoder.vocab_size()):
            if not any(f(k) for f in special):
                piece = self.encoder.id_to_piece(k)
                self.neighbours.update(zip(piece, piece[1:], strict=False))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Safe pieces of a text, in order; only the spaces between pieces are gone."""
        parts = text.replace("▁", " ").replace("\n", " \n").split(" ")
        return PieceCounter._joined(parts) if "" in parts else parts

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Undoes cuts beside other spaces; a cut before a line break was put in and holds no space."""
        out: list[str] = []
        held = parts[0]
        open_run = held == ""
        for part in parts[1:]:
            if part[:1] == "\n":
                out.append(held)
                held, open_run = part, False
            elif part == "" or open_run:
                held += " " + part
                open_run = part == ""
            else:
                out.append(held)
                held = part
        out.append(held)
        return out

    def segments(self, piece: str) -> list[str]:
        """A piece in parts of about `long` characters, as far as it has safe places; parts from the second on start behind one."""
        out, start = [], 0
        at = self.long
        while at < len(piece):
            a, b = piece[at - 1], piece[at]
            if a not in " \n" and b not in " \n" and (a, b) not in self.neighbours:
                out.append(piece[start:at])
                start, at = at, at + self.long
            else:
                at += 1
        return [*out, piece[start:]]

    def _counted(self, pieces: list[str]) -> dict[str, int]:
        """Tokens of distinct pieces, encoded in batches of about equal bytes."""
        found = dict.fromkeys(pieces, 0)
        batch: list[str] = []
        owners: list[tuple[str, int]] = []
        size = 0

        def encode() -> None:
            for (piece, extra), ids in zip(owners, self.encoder.encode(batch, num_threads=1), strict=True):
                found[piece] += len(ids) - extra
            batch.clear()
            owners.clear()

        for piece in pieces:
            parts = self.segments(piece) if len(piece) > self.long else [piece]
            for k, part in enumerate(parts):
                batch.append(part if k == 0 else "\n" + part)
                owners.append((piece, int(part[:1] == "\n") if k == 0 else 2))
                size += len(part) if part.isascii() else len(part.encode())
                if size >= self.batch_bytes:
                    encode()
                    size = 0
        if batch:
            encode()
        return found

    def _keep(self, found: dict[str, int]) -> None:
        for piece, n in found.items():
            size = len(piece) if piece.isascii() else len(piece.encode())
            if size <= KEPT_BYTES:
                self.young[piece] = n
                self.young_bytes += size
        if self.young_bytes > self.memo_bytes:
            self.old, self.young, self.young_bytes = self.young, {"": 0}, 0

    def count(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0
        for n, text in enumerate(texts):
            if not text:
                continue
            # a leading line break keeps the mark that stands before any text
            totals[n] += int(text[0] == "\n")
            pieces = self.pieces(text)
            for start in range(0, len(pieces), SLICE):
                part = pieces[start : start + SLICE] if len(pieces) > SLICE else pieces
                lengths = list(map(self.young.get, part))
                if None not in lengths:
                    totals[n] += sum(lengths)
                    continue
                held.append((n, part))
                size += sum(map(len, part))
                if size >= GROUP_BYTES:
                    self._settle(held, totals)
                    held, size = [], 0
        self._settle(held, totals)
        return totals

    def _settle(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        """Adds what the pieces of several texts come to; those that are not known are encoded together."""
        young = self.young
        new = dict.fromkeys(p for _, part in held for p in part if p not in young)
        missing = []
        for piece in new:
            new[piece] = self.old.get(piece)
            if new[piece] is None:
                missing.append(piece)
        new |= self._counted(missing)
        for n, part in held:
            totals[n] += sum(young[p] if p in young else new[p] for p in part)
        self._keep(new)


@cache
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_count(text: Column, model: str = MODEL) -> Column:
    """Number of tokens (long) of each whole text; null and empty texts have none.

    Begin, end and added special tokens are left out; their strings inside a text
    are ordinary text. Nothing is truncated or padded.
    """

    ship_package()

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(model_path(model)).count(texts.to_pylist()), pa.int64())

    return lengths(text)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, tokens and the limit flag of every document."""
    return (
        read_table(spark, sf_dir, "documents")
        .select(
            "doc_id",
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
            token_count(F.col("text")).alias("n_tokens"),
        )
        .withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
    )
