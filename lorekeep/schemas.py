"""Schemas of the stored tables and of the values that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, INT = T.StringType(), T.IntegerType()
VECTOR = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCUMENTS = _struct(
    id=TEXT, file_name=TEXT, file_path=TEXT, category=TEXT, indexed_at=T.TimestampType()
)
DOCUMENT_CONTENT = _struct(document_id=TEXT, raw_text=TEXT, embedding=VECTOR)
DOCUMENT_AI_METADATA = _struct(document_id=TEXT, summary=TEXT, keywords=T.ArrayType(TEXT))
CHUNKS = _struct(
    id=TEXT,
    document_id=TEXT,
    chunk_index=INT,
    text=TEXT,
    parent_text=TEXT,
    element_type=TEXT,
    page_number=INT,
    section=TEXT,
    embedding=VECTOR,
)
TABLES = {
    "documents": DOCUMENTS,
    "document_content": DOCUMENT_CONTENT,
    "document_ai_metadata": DOCUMENT_AI_METADATA,
    "chunks": CHUNKS,
}
PRIMARY_KEY = {
    "documents": "id",
    "document_content": "document_id",
    "document_ai_metadata": "document_id",
    "chunks": "id",
}
DOCUMENT_KEY = {**PRIMARY_KEY, "chunks": "document_id"}

FILES = _struct(path=TEXT, content=T.BinaryType())
ELEMENT = _struct(text=TEXT, element_type=TEXT, page_number=INT, section=TEXT)

QUESTIONS = _struct(id=T.LongType(), question=TEXT, theme=TEXT, expected_doc_hint=TEXT)
BENCH_RUNS = _struct(
    id=T.LongType(),
    question=TEXT,
    theme=TEXT,
    expected_doc_hint=TEXT,
    context_sources=T.ArrayType(TEXT),
    model=TEXT,
    answer_raw=TEXT,
    answer=TEXT,
    elapsed_s=T.DoubleType(),
    tokens=T.LongType(),
)
