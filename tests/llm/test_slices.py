"""Arrow batches are taken in slices, so a task holds little of a batch as Python values."""
import pyarrow as pa

from statproof.llm import near_dup, shared


def test_slices_are_bounded_by_the_bytes_of_a_column():
    batch = pa.record_batch({"k": [1, 2, 3, 4, 5, 6], "s": [b"12", None, b"345", b"123456789", b"", b"1"]})
    assert [x.column(0).to_pylist() for x in shared.slices(batch, 1, 6)] == [[1, 2, 3], [4], [5, 6]]
    assert list(shared.slices(batch.slice(0, 0), 1)) == []


def test_signatures_and_sets_leave_a_large_batch_in_parts():
    texts = [f"{'word ' * 200_000}{i}" for i in range(12)]  # 1 MB each
    rows = list(near_dup._signatures(5, 2, 2)(iter([pa.record_batch({"_row": list(range(12)), "_text": texts})])))
    assert [n for b in rows for n in b.column(0).to_pylist()] == list(range(12)) and max(b.num_rows for b in rows) <= 4
    sets = list(near_dup._sets(5)(iter([pa.record_batch({"c": list(range(12)), "_body": texts})])))
    assert sum(b.num_rows for b in sets) == 12 and max(b.num_rows for b in sets) <= 4
