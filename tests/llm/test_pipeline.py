"""The pipeline against plain versions of its stages, one after the other."""

from __future__ import annotations

from collections import Counter

import duckdb
import pandas as pd
import sentencepiece
from test_duplicates import classes_of, plain_repeats, plain_windows_of

import corpus_pipeline
from hypso.llm import pieces, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_sql(docs: pd.DataFrame, name: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", docs)
    return con.execute(queries.oracle_sql()[name]).df().set_index("doc_id")


def without_repeated_lines(docs: pd.DataFrame) -> pd.DataFrame:
    rows = [{"doc_id": r.doc_id, "text": r.text} for r in docs.itertuples(index=False)]
    left = {d: (text, n) for d, text, n in plain_repeats(rows, plain_windows_of)}
    out = []
    for row in docs.itertuples(index=False):
        text, n = left[row.doc_id]
        if text.split() or not n:
            out.append((row.doc_id, text, row.lang, row.source, len(text)))
    return pd.DataFrame(out, columns=COLUMNS)


def test_pipeline_equals_plain_stages(spark, tiny):
    docs = pd.read_parquet(f"{tiny}/documents.parquet")[COLUMNS]
    kept = by_sql(docs, "op8_robust_outliers").kept
    docs = docs[docs.doc_id.map(kept)]
    docs = without_repeated_lines(docs)
    classes = classes_of(dict(zip(docs.doc_id, docs.text, strict=True)))
    docs = docs[docs.doc_id == docs.doc_id.map(classes)]
    copies = by_sql(docs, "op2_curriculum_mixing").copies

    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    plain: Counter = Counter()
    for row in docs.itertuples(index=False):
        ids = [*library.encode(row.text), library.eos_id()]
        plain[row.doc_id, row.lang, row.source, row.n_chars, len(ids), tuple(ids), library.decode(ids)] += copies[row.doc_id]
    found = Counter((r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_tokens"], tuple(r["ids"]), r["text"]) for r in corpus_pipeline.run(spark, tiny).collect())
    assert found == +plain and len(found) > 100


def test_stages_are_the_stated_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "tokens"]
    assert "pipeline" not in queries.oracle_sql() and corpus_pipeline.ORACLE_SQL is None
