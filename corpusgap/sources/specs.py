"""Declarative corpus specs: where a corpus lies and how its columns become text and summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class CorpusSpec:
    """How one corpus is read.

    `hub` and `subset` are the public identifiers of the corpus; below the corpus root its
    files lie in <hub>/<subset>/split=<split>/. `directory` replaces that path for corpora that
    are kept in a folder of their own.
    """

    name: str
    hub: str
    subset: str
    columns: dict[str, str] = field(default_factory=dict)
    dropped: tuple[str, ...] = ()
    list_field: str | None = None
    summary_parts: tuple[str, ...] = ()
    directory: str | None = None
    file_format: str = "parquet"
    preprocess: Callable[[DataFrame], DataFrame] | None = None

    @property
    def path(self) -> str:
        return self.directory or f"{self.hub}/{self.subset}"


# The registered corpora.
_SPECS = [
    CorpusSpec("arxiv", "ccdv/arxiv-summarization", "document",
               {"article": "text", "abstract": "summary"}),
    CorpusSpec("govreport", "ccdv/govreport-summarization", "document", {"report": "text"}),
    CorpusSpec("bigpatent", "NortheasternUniversity/big_patent", "e",
               {"description": "text", "abstract": "summary"}),
    CorpusSpec("pubmed", "ccdv/pubmed-summarization", "document",
               {"article": "text", "abstract": "summary"}),
    CorpusSpec("wispermed", "tomasg25/scientific_lay_summarisation", "plos",
               {"article": "text"}, ("section_headings", "keywords", "year", "title")),
    CorpusSpec("cnndm", "abisee/cnn_dailymail", "1.0.0",
               {"article": "text", "highlights": "summary"}, ("id",)),
    CorpusSpec("samsum", "Samsung/samsum", "samsum", {"dialogue": "text"}, ("id",)),
    CorpusSpec("billsum", "FiscalNote/billsum", "default", {}, ("title",)),
    CorpusSpec("legalsum", "allenai/multi_lexsum", "v20230518",
               {"sources": "text", "summary/long": "summary"},
               ("sources_metadata", "summary/short", "summary/tiny", "id", "case_metadata"),
               list_field="sources"),
    CorpusSpec("newsroom", "lil-lab/newsroom", "default", {},
               ("title", "url", "date", "density", "coverage", "compression", "density_bin",
                "coverage_bin", "compression_bin"),
               directory="newsroom"),
    CorpusSpec("gigaword", "Harvard/gigaword", "document", {"document": "text"}),
    CorpusSpec("xlsum", "csebuetnlp/xlsum", "english", {}, ("id", "url", "title")),
    CorpusSpec("aclsum", "sobamchan/aclsum", "abstractive", {"document": "text"},
               ("challenge", "approach", "outcome"),
               summary_parts=("challenge", "approach", "outcome")),
    CorpusSpec("dialogsum", "knkarthick/dialogsum", "default", {"dialogue": "text"},
               ("id", "topic")),
]

CORPORA = {spec.name: spec for spec in _SPECS}


def corpus_spec(name: str, specs: dict[str, CorpusSpec] = CORPORA) -> CorpusSpec:
    if name not in specs:
        raise ValueError(f"unknown corpus {name!r}; known: {sorted(specs)}")
    return specs[name]
