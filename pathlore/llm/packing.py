"""Packing of examples into fixed-length training sequences by vector bin packing.

Each example is a point (tokens, segments, loss-bearing tokens); a sequence holds at most so much of each. The open
sequence takes the piece whose demand has the largest weighted dot product with the room that is left, so that pieces
that use up what is plentiful go in first; when none fits, the best is cut to the room.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.llm import tokens
from pathlore.llm._common import read, stored, text_or_empty

#: Pieces packed together by one task at a time; each leaves at most a few unfilled sequences.
BLOCK = 4096
_PIECE = "doc_id long, start long, length long, loss long, doc_tokens long, ids binary"


def place(sizes: np.ndarray, losses: np.ndarray, limits: tuple[int, int, int]) -> Iterator[tuple[int, int, int, int, int]]:
    """Places pieces; yields (sequence, piece, start in the piece, length, offset in the sequence).

    sizes: tokens of each piece, losses: how many of them, at its end, bear loss. limits: tokens, segments and
    loss-bearing tokens of a sequence. A piece never exceeds a limit by itself.
    """
    size, loss = sizes.astype(np.int64), losses.astype(np.int64)
    begun = np.zeros(len(size), np.int64)
    alive, n_alive = size > 0, int((size > 0).sum())
    most = np.array(limits, float)
    weight = np.array([size.mean() / most[0], 1 / most[1], loss.mean() / most[2]]) if len(size) else np.ones(3)
    demand = np.stack([size / most[0], np.full(len(size), 1 / most[1]), loss / most[2]], axis=1)
    sequence = 0
    while n_alive:
        room = np.array(limits, np.int64)
        offset = 0
        while n_alive and room[0] > 0 and room[1] > 0:
            worth = demand @ (weight * room / most)
            fits = alive & (size <= room[0]) & (loss <= room[2])
            if fits.any():
                best = int(np.argmax(np.where(fits, worth, -1)))
                n, bears = int(size[best]), int(loss[best])
                alive[best] = False
                n_alive -= 1
            else:
                best = int(np.argmax(np.where(alive, worth, -1)))
                plain = int(size[best] - loss[best])  # tokens before the first that bears loss
                n = int(min(size[best], room[0], plain + room[2]))
                bears = max(0, n - plain)
                if n <= 0:
                    break
                size[best] -= n
                loss[best] -= bears
                demand[best] = size[best] / most[0], 1 / most[1], loss[best] / most[2]
            yield sequence, best, int(begun[best]), n, offset
            begun[best] += n
            offset += n
            room -= (n, 1, bears)
        sequence += 1


def pack(
    docs: DataFrame, vocab: Callable[[], str], end: int, drops_space: bool, id_col: str = "doc_id", response: str = "text",
    prompt: str | None = None, max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None,
) -> DataFrame:
    """Packs every row's ids (prompt, response, end id) into sequences; one row per piece, with its ids.

    Tokens of the response and the end id bear loss, those of the prompt don't. Null text counts as empty: such a row
    is a piece of the end id alone. Null, repeated and tied ids are rows like any others. An empty table gives no rows;
    other columns aren't read. A row longer than a sequence is cut into full sequences and a rest; rests are dealt to
    blocks of about BLOCK rows at random, which are packed on their own.

    Returns doc_id, start, length, loss (loss-bearing tokens), doc_tokens, sequence_id, offset, ids (bytes, unsigned
    little-endian 32-bit).
    """
    most_loss = max_tokens if max_loss is None else max_loss
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(prompt or F.lit("")).alias("prompt"), text_or_empty(response).alias("response")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocab(), end, drops_space)
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            out: list[tuple] = []
            ids, counts = encode(batch["response"].to_pylist())
            heads, plain = encode(batch["prompt"].to_pylist(), end=False) if prompt else (ids[:0], np.zeros(len(counts), np.int64))
            at = np.cumsum(counts) - counts
            head_at = np.cumsum(plain) - plain
            for row, key in enumerate(batch["doc_id"].to_pylist()):
                own = np.concatenate([heads[head_at[row] : head_at[row] + plain[row]], ids[at[row] : at[row] + counts[row]]])
                start = 0
                while start < len(own):
                    before = max(0, int(plain[row]) - start)
                    n = min(max_tokens, before + most_loss, len(own) - start)
                    out.append((key, start, n, max(0, n - before), len(own), own[start : start + n].astype("<u4").tobytes()))
                    start += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [*[pa.int64()] * 5, pa.binary()], strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    # the salt is of the row's place in its task, drawn once and written: equal keys don't meet in one block
    pieces = stored(rows.mapInArrow(cut, _PIECE).withColumn("salt", F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())), "pack-pieces")
    full = (F.col("length") == max_tokens) | (F.col("loss") == most_loss)
    rests = pieces.where(~full)
    blocks = max(1, round(rests.count() / BLOCK))

    def pack_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "start", "salt"], kind="stable").reset_index(drop=True)
        out, length, loss, ids = [], block["length"].to_numpy(), block["loss"].to_numpy(), block["ids"]
        for sequence, i, begin, n, offset in place(length, loss, (max_tokens, max_segments, most_loss)):
            before = max(0, int(length[i] - loss[i]) - begin)
            out.append((i, begin, n, max(0, n - before), 2 * (key[0] * (1 << 20) + sequence), offset, ids[i][4 * begin : 4 * (begin + n)]))
        made = pd.DataFrame(out, columns=["i", "begin", "length", "loss", "sequence_id", "offset", "ids"])
        own = block.iloc[made["i"]]
        return pd.DataFrame({
            "doc_id": own["doc_id"].array, "start": own["start"].to_numpy() + made["begin"], "length": made["length"], "loss": made["loss"],
            "doc_tokens": own["doc_tokens"].array, "sequence_id": made["sequence_id"], "offset": made["offset"], "ids": made["ids"],
        })

    out_schema = "doc_id long, start long, length long, loss long, doc_tokens long, sequence_id long, offset long, ids binary"
    of_rests = rests.withColumn("block", F.pmod("salt", F.lit(blocks))).groupBy("block").applyInPandas(lambda key, block: pack_block(key, block.drop(columns="block")), out_schema)
    alone = pieces.where(full).select(
        "doc_id", "start", "length", "loss", "doc_tokens", (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    return alone.unionByName(of_rests)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents packed as the training run wants them: 2048 tokens, 256 segments, every token bears loss."""
    return pack(docs, lambda: tokens.vocabulary("word_bpe_49k.json"), end=1, drops_space=True)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    return pack_documents(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss"
    )
