"""What a worker holds beside its texts while it cuts and puts units together."""

import tracemalloc

import numpy as np

from maskara.llm import units


def test_pieces_are_put_together_in_parts():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 12, 400_000)
    lengths[[5, 6]] = 0, units.TAKEN + 7  # longer than a part
    data = rng.integers(0, 256, int(lengths.sum()), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    codes = rng.permutation(len(lengths))
    tracemalloc.start()
    got, each = units.gathered(codes, lengths, data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (each == lengths[codes]).all() and len(got) == len(data)
    assert got.tobytes() == b"".join(data[starts[c] : starts[c] + lengths[c]].tobytes() for c in codes.tolist())
    assert peak < 12 * len(data), "eight bytes a byte, twice, for all pieces at once"
    empty = units.gathered(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8))
    assert len(empty[0]) == 0 and len(units.gathered(np.array([0, 0]), np.array([0]), np.zeros(0, dtype=np.uint8))[0]) == 0


def test_file_table_in_small_pages(spark, tmp_path):
    """The files of tokens are written without a codec, whose buffers would be as large as a page of a hundred files."""
    import pyarrow.parquet as pq

    from maskara.llm import token_store

    token_store.write(spark.createDataFrame([(i, f"a text of some words {i}") for i in range(50)], "doc_id long, text string"), at := str(tmp_path / "t"))
    parts = [pq.ParquetFile(p).metadata for p in (tmp_path / "t").glob("*.parquet")]
    assert sum(m.num_rows for m in parts) > 0
    assert {m.row_group(g).column(c).compression for m in parts for g in range(m.num_row_groups) for c in range(m.num_columns)} == {"UNCOMPRESSED"}
    assert token_store.documents(token_store.read(spark, at)).count() == 50


def test_numbers_are_packed_in_parts():
    """A block's places of units are packed and unpacked without a second copy of them all."""
    from maskara.llm import bpe

    rng = np.random.default_rng(2)
    numbers = (rng.integers(0, 1 << 32, 2_000_000, dtype=np.uint64) >> rng.integers(0, 33, 2_000_000, dtype=np.uint64)).astype(np.uint32)
    tracemalloc.start()
    data = bpe._packed(numbers)
    packing = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    got = bpe._unpacked(data)
    unpacking = tracemalloc.get_traced_memory()[1] - len(data)
    tracemalloc.stop()
    assert (got == numbers).all()
    assert packing < 3 * numbers.nbytes and unpacking < 3 * numbers.nbytes
    for few in ([], [0], [255, 256, 65_535, 65_536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]):
        assert bpe._unpacked(bpe._packed(np.array(few, dtype=np.int64))).tolist() == few
