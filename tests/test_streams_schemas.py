"""Stripping of pieces, upload paths and schema checks against stated results."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.functions import records
from vectrail.sources import readers
from vectrail.streaming import streams


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<think>", "</think>", "<", "th", "<thi", "nk>", "</", "k>", "a", "b c", ""]), max_size=12), st.lists(st.integers(0, 60), max_size=6))
def test_pieces_are_stripped_as_the_whole(parts, cuts):
    whole = "".join(parts)
    cuts = sorted({min(c, len(whole)) for c in cuts} | {0, len(whole)})
    inside, held, shown = False, "", ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        out, inside, held = streams.strip_piece(inside, held, whole[a:b])
        shown += out
    bare = re.sub(r"<think>.*?(</think>|$)|</think>", "", whole, flags=re.S)
    assert shown + ("" if inside else held) == bare


def test_uploaded_path():
    assert readers.uploaded_path("upload://file-1", "s3a://store/") == "s3a://store/file-1"
    assert readers.uploaded_path("upload://a/b.parquet", "/x") == "/x/a/b.parquet"
    for uri in ("s3://file-1", "upload://", "upload://../x", "upload://a/../../x", "file-1"):
        with pytest.raises(ValueError):
            readers.uploaded_path(uri, "/x")


def test_field_specs():
    schema = {
        "type": "object", "required": ["name"], "additionalProperties": False,
        "properties": {
            "name": {"type": "string", "description": "who:: it is"}, "kind": {"type": "string", "enum": ["a", "b"], "title": "sort"}, "tags": {"type": "array", "items": {"type": "string"}},
        },
    }
    assert records.field_specs(schema) == ["name::str::who: it is", "kind::[a|b]::str::sort", "tags::list"]


@pytest.mark.parametrize(
    "change",
    [
        {"type": "array"}, {"properties": {}}, {"allOf": []}, {"required": ["no"]}, {"required": ["a", "a"]}, {"required": "a"}, {"additionalProperties": {}},
        {"properties": {"a|b": {"type": "string"}}}, {"properties": {"a": {"type": "number"}}}, {"properties": {"a": {"type": "string", "enum": []}}},
        {"properties": {"a": {"type": "string", "enum": ["x]"]}}}, {"properties": {"a": {"type": "string", "pattern": "x"}}}, {"properties": {"a": {"type": "array", "items": {"type": "number"}}}},
        {"properties": {"a": {"type": "string", "description": 3}}}, {"properties": {"a": "string"}},
    ],
)
def test_field_specs_refuse(change):
    with pytest.raises(ValueError):
        records.field_specs({"type": "object", "properties": {"a": {"type": "string"}}} | change)


def _nested(n):
    return {"type": "string"} if n == 0 else {"items": _nested(n - 1)}


def test_check_output_schema():
    records.check_output_schema(_nested(16))
    records.check_output_schema({"type": "object", "properties": {"a": {"enum": list(range(100))}}})
    for bad in (_nested(17), [], {"properties": {"a": {"$ref": "#/x"}}}, {"anyOf": [{"if": {}}]}, {"enum": ["x" * 70_000]}, {"enum": [0] * 17_000}):
        with pytest.raises(ValueError):
            records.check_output_schema(bad)
    with pytest.raises(ValueError, match=r"schema\.anyOf\[1\]\.then"):
        records.check_output_schema({"anyOf": [{}, {"then": {}}]})
