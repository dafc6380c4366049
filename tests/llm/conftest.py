from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def write_tables(folder, docs, labels=(), extra=None):
    """A folder of tables as the queries read them."""
    columns = {name: [d[i] if i < len(d) else None for d in docs] for i, name in enumerate(SCHEMA.names)}
    columns["n_chars"] = [len(t) if t is not None else None for t in columns["text"]]
    table = pa.table(columns, schema=SCHEMA)
    for name, values in (extra or {}).items():
        table = table.append_column(name, pa.array(values))
    pq.write_table(table, folder / "documents.parquet")
    marks = pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]}, schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())]))
    pq.write_table(marks, folder / "labels.parquet")
    return str(folder)


ODD_TEXTS = [
    None,
    "",
    "  \n\t ",
    "word",
    "two words",
    "The cat sat on the mat and looked at the dog that slept by the door of the old house.",
    "The cat sat on the mat and looked at the dog that slept by the door of the old house.",
    "Éléphant über ñandú 漢字 😀 <|endoftext|> end",
    "\x00\x01 control \x1c chars   and no-break",
    "same " * 400,
    "ha" * 3000,
    " ".join(f"w{i}" for i in range(60_000)),
    "Licensed under the Apache License, Version 2.0.",
    "you are an i d i o t and a worthless c-l-o-w-n",
]


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    """Nulls in all columns, empty, very long and repeated texts, repeated and null ids, and columns with clashing names."""
    texts = [*ODD_TEXTS, ODD_TEXTS[5], None]
    ids = [*range(len(ODD_TEXTS)), 5, None]
    langs = [("en", "de", None)[i % 3] for i in range(len(texts))]
    docs = list(zip(ids, texts, langs, ["s", None] * 8))
    extra = {name: list(range(len(texts))) for name in ("node", "key", "word", "words", "digest", "shingles", "quality_rules", "w_text", "kept", "length", "part", "spans", "block", "train", "root", "range", "h")}
    return write_tables(tmp_path_factory.mktemp("odd"), docs, [(i, i % 2, i % 2) for i in range(14)] + [(None, None, None), (3, 1, None)], extra)


@pytest.fixture(scope="session")
def none(tmp_path_factory):
    """Tables without rows."""
    return write_tables(tmp_path_factory.mktemp("none"), [])
