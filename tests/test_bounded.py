"""What a Python worker holds doesn't grow with the rows of a batch: steps run on one batch, as Spark gives it to them."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from gridloom.operators import coding, fields
from gridloom.plans.commands import random_field


class Captured:
    """Stands for a DataFrame: keeps the function that a step gives to the workers."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def mapInPandas(self, run, _):
        def on_arrow(batches):
            for pdf in run(b.to_pandas() for b in batches):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

        return self.mapInArrow(on_arrow, _)


def blocks(n: int, column: str = "data") -> pa.RecordBatch:
    u = np.round(100 * random_field((33,)))
    rows = [u + k % 7 for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(rows, pa.list_(pa.float64() if column == "data" else pa.int64()))], names=["block_id", column])


def held(step, batch: pa.RecordBatch, *args) -> tuple[int, int, int]:
    """Most bytes of Python and of one result, and rows."""
    frame, rows, largest = Captured(), 0, 0
    step(frame, *args)
    pool = pa.default_memory_pool()
    before, most = pool.bytes_allocated(), 0
    tracemalloc.start()
    for out in frame.run(iter([batch])):
        rows, largest = rows + out.num_rows, max(largest, out.nbytes)
        most = max(most, pool.bytes_allocated() - before)
    peak = tracemalloc.get_traced_memory()[1] + most
    tracemalloc.stop()
    return peak, largest, rows


def test_refactor_is_bounded():
    small, large = (held(fields.refactor, blocks(n)) for n in (600, 2400))
    assert (small[2], large[2]) == (600 * 6 * 32, 2400 * 6 * 32)
    assert large[0] < 1.3 * small[0] and large[1] <= 1.3 * small[1]


def coded(batch: pa.RecordBatch, step, *args) -> pa.RecordBatch:
    """All that a step makes of a batch, as the one batch of the next step."""
    frame = Captured()
    step(frame, *args)
    return pa.Table.from_batches(list(frame.run(iter([batch])))).combine_chunks().to_batches()[0]


def test_compress_and_decompress_are_bounded():
    batches = [blocks(n) for n in (2000, 8000)]
    there = [held(fields.compress, b, None, 0.5, np.inf, "raw") for b in batches]
    back = [held(fields.decompress, coded(b, fields.compress, None, 0.5, np.inf, "raw")) for b in batches]
    for small, large in (there, back):
        assert (small[2], large[2]) == (2000, 8000)
        assert large[1] <= 1.3 * small[1] and large[0] < 2 * small[0]


def test_encode_and_decode_are_bounded():
    batches = [blocks(n, "q") for n in (2000, 8000)]
    there = [held(coding.encode_blocks, b, "raw") for b in batches]
    back = [held(coding.decode_blocks, coded(b, coding.encode_blocks, "raw")) for b in batches]
    for small, large in (there, back):
        assert (small[2], large[2]) == (2000, 8000)
        assert large[1] <= 1.3 * small[1] and large[0] < 2 * small[0]


def test_short_payloads_of_long_blocks():
    """A payload of a few bytes may hold many values."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([[7] * 30_000] * 40, pa.list_(pa.int64()))], names=["block_id", "q"])
    packed = coded(batch, coding.encode_blocks, "zstd")
    assert packed.nbytes < 10_000
    frame = Captured()
    coding.decode_blocks(frame)
    out = list(frame.run(iter([packed])))
    assert max(x.nbytes for x in out) < 8 * (coding.PIECE + 30_000) + 1000
    assert pa.Table.from_batches(out).to_pydict() == batch.to_pydict()


@pytest.mark.parametrize("codec", ["zstd", "huffman+zstd"])
def test_empty_and_long_rows(codec):
    rows = [[], [1 << 60, -5], list(range(100_000)), [3], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(rows, pa.list_(pa.int64()))], names=["block_id", "q"])
    assert coded(coded(batch, coding.encode_blocks, codec), coding.decode_blocks).to_pydict() == batch.to_pydict()


def test_refine_sends_only_what_it_reads(spark):
    """Errors and sizes serve the plan: groups of payloads come to the workers without them."""
    fragments = fields.refactor(spark.createDataFrame([(1, random_field((33,)).tolist())], "block_id long, data array<double>"))
    groups = fields.refine(fragments, fields.request(fragments, 0.1))._jdf.queryExecution().optimizedPlan().children().head()
    assert not {"sq_before", "sq_after", "size", "planes"} & {x.split("#")[0] for x in groups.output().mkString(" ").split()}
