"""JSON documents of any nesting checked value by value.

Spark parses the documents (VARIANT) and writes them out again, so what is JSON
and what is not is its parser's matter; one pass then walks each document and
gives one row a violation. Nothing is shuffled or written between, and a task
holds a batch of documents.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

#: Names of keys that would carry identifiers, and the digest algorithms that are known (fixed values).
FORBIDDEN = frozenset("sample_ids sample_id_list eid eids iids members individual_ids participant_ids".split())
ALGORITHMS = ("sha256_full", "sha256_head_tail_size", "none")
PROBLEM = "id string, problem string, path string"


class Number(str):
    """A number as the document writes it."""


def _text(value: object) -> str | None:
    """A scalar's text; none for null and containers."""
    return str(value).lower() if isinstance(value, bool) else value if isinstance(value, str) else None


def _walked(document: object, long: int, digest_key: str, algorithms: frozenset[str], forbidden: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(problem, path) of forbidden keys, unknown algorithms and long lists of texts at any depth, without recursion."""
    left = [("", document)]
    while left:
        path, node = left.pop()
        if type(node) is dict:
            dot = path + "." if path else ""
            for key, value in node.items():
                at = dot + key
                if key in forbidden:
                    yield "forbidden key", at
                if key == digest_key and _text(value) not in algorithms:
                    yield "unknown algorithm", at
                if type(value) is list:
                    if len(value) > long and all(type(x) is str for x in value):
                        yield "long text list", at
                    else:
                        left.append((at, value))
                elif type(value) is dict:
                    left.append((at, value))
        elif type(node) is list:
            left += [(f"{path}[{i}]", x) for i, x in enumerate(node) if type(x) is dict or type(x) is list]


def violations(documents: DataFrame, id_col: str, json_col: str, required: Iterable[str] = (), must_be_false: Iterable[str] = (), constants: dict[str, str] | None = None, longest_list: int = 200, digest_key: str = "algorithm", algorithms: Iterable[str] = ALGORITHMS, forbidden: Iterable[str] = FORBIDDEN) -> DataFrame:
    """(id, problem, path) of each rule that a document breaks.

    Keys that must be there, or be false, or have a given text, stand at the top. Forbidden keys, lists of more than longest_list
    members that are all texts, and unknown digest algorithms are looked for at any depth.
    """
    must, false, declared = list(required), list(must_be_false), dict(constants or {})
    known, names = frozenset(algorithms), frozenset(forbidden)
    ship(documents.sparkSession)

    def found(document: object) -> Iterator[tuple[str, str]]:
        if type(document) is not dict:
            yield "no object", ""
        else:
            yield from (("missing", k) for k in must if k not in document)
            yield from (("not false", k) for k in false if document.get(k) is not False)
            yield from (("not as declared", k) for k, v in declared.items() if _text(document.get(k)) != v)
        yield from _walked(document, longest_list, digest_key, known, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: Callable[[str], object] = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=Number).decode
        for batch in batches:
            out = [(name, *p) for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in found(None if body is None else read(body))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["id", "problem", "path"])

    return documents.select(F.col(id_col).cast("string").alias("id"), F.to_json(F.try_parse_json(json_col)).alias("body")).mapInArrow(run, PROBLEM)
