import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOC = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
    # names that the operators use inside
    ("row_id", pa.string()), ("kept", pa.string()), ("copies", pa.string()), ("digest", pa.string()), ("shard", pa.string()), ("score", pa.string()), ("__x", pa.string()),
])


@pytest.fixture
def write_docs(tmp_path):
    """Writes rows (doc_id, text, source) as documents.parquet, with clashing extra columns, and returns the folder."""

    def write(rows, labels=()):
        full = [(i, t, None, s, None, "r", None, "c", "d", "s", "x", None) for i, t, s in rows]
        columns = list(zip(*full)) if full else [[]] * len(DOC)
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, DOC)], schema=DOC), tmp_path / "documents.parquet")
        ids, toxic = zip(*labels) if labels else ((), ())
        pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "quality": pa.array([None] * len(ids), pa.int32()), "toxic": pa.array(toxic, pa.int32())}), tmp_path / "labels.parquet")
        return str(tmp_path)

    return write


LONG = "tail " * 30000
EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "Same text here", "b"), (5, "same TEXT here", "b"), (5, "same TEXT here", "b"),
    (None, "same text here", None), (None, None, None), (6, "Äpfel äpfel", "c"), (7, "äpfel äpfel", "c"), (8, LONG, "a"), (9, "one", "d"), (10, "one two", "d"),
]


@pytest.fixture
def edge_rows():
    return list(EDGES)
