"""Markdown columns: frontmatter, title, heading sections and their parts.

Everything here works inside one row (a note is one row), so no step shuffles
the corpus: frontmatter is a fold over the note's own lines, headings are found
by one scan of its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelake.functions.text import WS, WHITESPACE, content_hash, is_blank, newline_count, token_estimate, trim_ws
from notelake.params import ChunkParams

# The note dialect.
FRONTMATTER = "(?s)\\A---[ \\t]*\\r?\\n(?:(.*?)\\r?\\n)?---[ \\t]*(?:\\r?\\n|\\z)"
KEY_LINE = "^([\\w-]+):[ \\t]*(.*)$"
ITEM_LINE = "^[ \\t]*-[ \\t]+(.*)$"
HEADING = f"^(#{{1,6}}){WS}+(.*){WS}*\\z"
FIRST_H1 = f"(?m)^#{WS}+(.+)$"
FENCE = "```"
#: Text bytes that a task cuts at once.
SLICE_BYTES = 4 << 20

ENTRY_TYPE = "struct<key:string,is_list:boolean,vals:array<string>>"
_LIST_KEYS = ("tags", "title", "ref_code_paths")


def frontmatter_raw(content: Column) -> Column:
    return F.regexp_extract(content, FRONTMATTER, 1)


def body_text(content: Column) -> Column:
    """Note text behind the frontmatter; a blank file has an empty body."""
    return F.when(is_blank(content), "").otherwise(F.regexp_replace(content, FRONTMATTER, ""))


def body_offset(content: Column) -> Column:
    """Lines taken by the frontmatter: add it to a body line to get the file line."""
    return newline_count(content) - newline_count(F.regexp_replace(content, FRONTMATTER, ""))


def _unquote(col: Column) -> Column:
    plain = trim_ws(F.regexp_replace(col, "[ \\t]#.*$", ""))
    quoted = F.regexp_replace(col, "^([\"'])(.*)\\1$", "$2")
    return F.when(col.rlike("^[\"']"), quoted).otherwise(plain)


def _scalar_or_list(value: Column) -> Column:
    inner = F.split(F.regexp_replace(value, "^\\[|\\]$", ""), ",")
    items = F.filter(F.transform(inner, lambda v: _unquote(trim_ws(v))), lambda v: v != "")
    empty = F.array().cast("array<string>")
    inline = value.rlike("^\\[.*\\]$")
    vals = F.when(inline, items).when(value == "", empty).otherwise(F.array(_unquote(value)))
    return F.struct(inline.alias("is_list"), vals.alias("vals"))


def frontmatter_entries(raw: Column) -> Column:
    """Ordered ``(key, is_list, vals)`` entries: scalars, inline lists, block lists.

    A repeated key keeps its last value. Anything else in the block is left to
    the raw text.
    """
    empty = F.array().cast(f"array<{ENTRY_TYPE}>")

    def step(acc: Column, line: Column) -> Column:
        key = F.regexp_extract(line, KEY_LINE, 1)
        parsed = _scalar_or_list(trim_ws(F.regexp_extract(line, KEY_LINE, 2)))
        opened = F.concat(
            F.filter(acc, lambda e: e["key"] != key),
            F.array(
                F.struct(key.alias("key"), parsed["is_list"].alias("is_list"), parsed["vals"].alias("vals"))
            ).cast(f"array<{ENTRY_TYPE}>"),
        )
        last = F.element_at(acc, -1)
        item = _unquote(trim_ws(F.regexp_extract(line, ITEM_LINE, 1)))
        grown = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(
                F.struct(
                    last["key"].alias("key"),
                    F.lit(True).alias("is_list"),
                    F.concat(last["vals"], F.array(item)).alias("vals"),
                )
            ).cast(f"array<{ENTRY_TYPE}>"),
        )
        return (
            F.when(key != "", opened)
            .when(line.rlike(ITEM_LINE) & (F.size(acc) > 0), grown)
            .otherwise(acc)
        )

    return F.aggregate(F.split(raw, "\\r?\\n"), empty, step)


def entry_vals(entries: Column, key: str) -> Column:
    """Values of one key, NULL when the key is absent."""
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["vals"]


def frontmatter_map(entries: Column) -> Column:
    return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["vals"])))


def note_title(entries: Column, body: Column, path: Column) -> Column:
    """Frontmatter title, else the first level-1 heading, else the file name."""
    heading = F.when(body.rlike(FIRST_H1), trim_ws(F.regexp_extract(body, FIRST_H1, 1)))
    name = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), "\\.md$", "")
    return F.coalesce(F.get(entry_vals(entries, "title"), F.lit(0)), heading, name)


def ref_code_paths(entries: Column) -> Column:
    """Trimmed non-empty code references; NULL when the key is absent or blank."""
    vals = entry_vals(entries, "ref_code_paths")
    is_list = _entry_is_list(entries, "ref_code_paths")
    clean = F.filter(F.transform(vals, trim_ws), lambda v: v != "")
    return F.when(is_list | (F.size(clean) > 0), clean)


def ref_scalar_warning(entries: Column) -> Column:
    """True when ``ref_code_paths`` is a single value where a list is expected."""
    refs = ref_code_paths(entries)
    return F.coalesce(~_entry_is_list(entries, "ref_code_paths") & (F.size(refs) > 0), F.lit(False))


def _entry_is_list(entries: Column, key: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["is_list"]


def tags_text(entries: Column) -> Column:
    return F.coalesce(F.array_join(entry_vals(entries, "tags"), ","), F.lit(""))


def properties_text(entries: Column) -> Column:
    """``key:value`` pairs of every key without a field of its own."""
    others = F.filter(entries, lambda e: ~e["key"].isin(*_LIST_KEYS))
    pairs = F.transform(
        others,
        lambda e: F.concat(
            e["key"],
            F.lit(":"),
            F.when(~e["is_list"] & (F.size(e["vals"]) == 0), "null").otherwise(
                F.array_join(e["vals"], ",")
            ),
        ),
    )
    return F.array_join(pairs, " ")


def source_kind(path: Column) -> Column:
    """Kind of a note from its first folder."""
    folder = F.regexp_extract(path, "^([^/]+)/", 1)
    # Folder to kind.
    kinds = {
        "code-notes": "code_note",
        "rules": "rule",
        "integrations": "integration_doc",
        "sessions": "session",
        "structure": "dir_map",
    }
    out = F.lit("other")
    for name, kind in kinds.items():
        out = F.when(folder == name, kind).otherwise(out)
    return out


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parse_notes(notes: DataFrame) -> DataFrame:
    """``path, content`` (+ any other columns) to document rows with a body.

    Adds title, content hash, frontmatter map, tags, code references and the
    text of the two frontmatter-based lexical fields.
    """
    staged = notes.withColumns(
        {
            "doc_path": normal_path(F.col("path")),
            "frontmatter_raw": frontmatter_raw(F.col("content")),
            "body": body_text(F.col("content")),
        }
    ).withColumn("_entries", frontmatter_entries(F.col("frontmatter_raw")))
    entries = F.col("_entries")
    return staged.withColumns(
        {
            "doc_id": F.xxhash64("doc_path"),
            "title": note_title(entries, F.col("body"), F.col("doc_path")),
            "source_kind": source_kind(F.col("doc_path")),
            "content_hash": content_hash(F.col("content")),
            "body_offset": body_offset(F.col("content")),
            "frontmatter": frontmatter_map(entries),
            "tags": F.coalesce(entry_vals(entries, "tags"), F.array().cast("array<string>")),
            "tags_text": tags_text(entries),
            "properties_text": properties_text(entries),
            "ref_code_paths": ref_code_paths(entries),
            "ref_scalar_warning": ref_scalar_warning(entries),
        }
    ).drop("_entries", "path", "content")


#: Within a note, headings and fences stand at the start of a line; white space there is all but the line break.
_GAP = "[\\t\\v\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_HEADING_LINE = re.compile(f"^(#{{1,6}}){_GAP}+([^\\n\\r\u0085\u2028\u2029]*){_GAP}*$", re.M)
_FENCE_LINE = re.compile(f"^{_GAP}*{FENCE}", re.M)
_PARAGRAPHS = re.compile("(\n\n+)")


def _units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def _headings(body: str) -> list[tuple[int, str]]:
    """Offset and heading path of every section: the text before the first heading, then one per heading.

    A heading is one if an even number of fences is above it. The path is kept as a stack of falling levels.
    """
    found = list(_HEADING_LINE.finditer(body))
    if not found:
        return [(0, "")]
    fences = np.array([m.start() for m in _FENCE_LINE.finditer(body)])
    above = np.searchsorted(fences, [m.start() for m in found])
    out, stack = [(0, "")], []
    for m, n in zip(found, above.tolist(), strict=True):
        if n % 2:
            continue
        level = len(m[1])
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, m[2].strip(WHITESPACE)))
        out.append((m.start(), " / ".join(title for _, title in stack)))
    return out


def _packed(text: str, line: int, limit: int) -> list[tuple[int, int, str]]:
    """First line, last line and text of the parts of a long section: paragraphs are packed up to ``limit``.

    A paragraph above the limit stays whole. Line numbers are the true ones.
    """
    pieces = _PARAGRAPHS.split(text)  # paragraph, gap, paragraph, ...
    out, held, size, first, last = [], [], 0, line, line
    for i in range(0, len(pieces), 2):
        para = pieces[i]
        units = _units(para)
        if held and size + 2 + units > limit:
            out.append((first, last, "\n\n".join(held)))
            held, size, first = [], -2, line
        size += units + 2 if held or size < 0 else units
        held.append(para)
        last = line + para.count("\n")
        line = last + (len(pieces[i + 1]) if i + 1 < len(pieces) else 0)
    return [(a, b, t.strip(WHITESPACE)) for a, b, t in [*out, (first, last, "\n\n".join(held))]]


def _chunks(body: str, limit: int) -> list[tuple[str, int, int, str]]:
    """Heading path, first line, last line and text of the chunks of a note. Every pass is linear in the note."""
    starts = _headings(body)
    breaks = np.array([m.start() for m in re.finditer("\n", body)])
    lines = np.searchsorted(breaks, [at for at, _ in starts]).tolist()
    ends = [at - 1 for at, _ in starts[1:]] + [len(body)]
    until = [*lines[1:], len(breaks) + 1]
    out = []
    for (at, path), end, line, stop in zip(starts, ends, lines, until, strict=True):
        raw = body[at : max(at, end)]
        text = raw.strip(WHITESPACE)
        if not text:
            continue
        if _units(text) <= limit:
            out.append((path, line + 1, stop, text))
            continue
        blank = len(raw) - len(raw.lstrip(WHITESPACE))
        out += [(path, a, b, t) for a, b, t in _packed(text, line + 1 + raw.count("\n", 0, blank), limit) if t]
    return out


def chunk_notes(docs: DataFrame, body: str = "body", params: ChunkParams = ChunkParams()) -> DataFrame:
    """One row per chunk: headings cut sections, oversized sections are split.

    Keeps every other column of ``docs``. Lines are counted in the body. A note is one row and is cut where it
    is; time and memory are linear in its length, however many headings and fences it has.
    """
    keep = [c for c in docs.columns if c != body]
    limit = params.split_chars
    own = ["chunk_index", "heading_path", "start_line", "end_line", "text"]
    kinds = [T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType()]
    inner = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    schema = T.StructType([*inner.fields, *(T.StructField(c, k) for c, k in zip(own, kinds, strict=True))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0)
            begin = 0
            while begin < batch.num_rows:  # a batch of a few megabytes of text, or one note
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
                made = [_chunks(t, limit) if t else [] for t in texts.slice(begin, end - begin).to_pylist()]
                of = np.repeat(np.arange(begin, end), [len(x) for x in made])
                flat = [x for note in made for x in note]
                columns = [batch.column(i).take(pa.array(of)) for i in range(len(keep))]
                columns.append(pa.array([i for note in made for i in range(len(note))], pa.int32()))
                columns += [pa.array([x[j] for x in flat], k) for j, k in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                begin = end

    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)), F.col(f"`{body}`").alias("body"))
    made = plain.mapInArrow(cut, schema)
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *own).withColumns(
        {
            "text_hash": content_hash(F.col("text")),
            "token_estimate": token_estimate(F.col("text"), params.chars_per_token),
        }
    )
