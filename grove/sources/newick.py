"""Newick text, read and written.

Reading takes a table of texts, a tree or forest each; a text is parsed by
passes over arrays of its bytes, or, with quotes, comments or errors, in one
pass by whole tokens. Ids are given at each opening bracket and comma, so
parents come first and ids are row numbers. Writing pads each node's token
with the brackets that its depth asks for and strings the tokens of a tree
together in the order of the walk.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.columns import is_root, make_ancestor_list
from grove.operators.marks import mark_origin_time_delta
from grove.plans.folds import euler, keys
from grove.plans.numbering import numbered

#: A quoted label, a structural character, a comment's bracket, white space, or other text.
_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),:;\[\]]|\s+|[^(),:;\[\]\s']+|'")
#: Fixed value: characters that make a label need quotes.
UNSAFE_SYMBOLS = ";(),[]:' \t\n"


class NewickError(ValueError):
    pass


def parse_newick(text: str, replace_unquoted: Mapping[str, str] | None = None) -> tuple[list[int], list[str], list[float | None], int]:
    """Ancestors, labels, lengths by id, and the number of trees."""
    swap = str.maketrans(dict(replace_unquoted or {}))
    ancestors: list[int] = []
    labels: list[str] = []
    lengths: list[float | None] = []
    stack: list[int] = []
    trees, current, length, comment = 0, -1, False, 0

    def node(parent: int | None) -> int:
        ancestors.append(len(ancestors) if parent is None else parent)
        labels.append("")
        lengths.append(None)
        return len(ancestors) - 1

    for match in _TOKEN.finditer(text):
        token = match[0]
        if token == "[" or comment:
            comment += (token == "[") - (token == "]")
            continue
        if token[0].isspace():
            if labels and labels[current] and not length and token[0] == " " and current >= 0:
                labels[current] += token  # kept within a label, cut off at its end
            continue
        if current < 0:
            if token == ";":
                continue
            current = node(None)
        if token == "(":
            stack.append(current)
            current, length = node(current), False
        elif token == ",":
            if not stack:
                raise NewickError("a comma outside brackets")
            current, length = node(stack[-1]), False
        elif token == ")":
            if not stack:
                raise NewickError("more brackets closed than opened")
            current, length = stack.pop(), False
        elif token == ":":
            length = True
        elif token == ";":
            if stack:
                raise NewickError("a bracket is open at the end of a tree")
            current, length, trees = -1, False, trees + 1
        elif length:
            lengths[current] = float(token)
        elif token[0] == "'":
            if len(token) < 2:
                raise NewickError("a quote is open")
            labels[current] += token[1:-1].replace("''", "'")
        else:
            labels[current] += token.translate(swap)
    if stack or comment:
        raise NewickError("a bracket is open at the end")
    return ancestors, [x.rstrip(" ") for x in labels], lengths, trees + (current >= 0)


#: Codes of structural characters; a tree's start is one more.
_CODES = np.zeros(256, np.uint8)
_OPEN, _COMMA, _CLOSE, _COLON, _END, _START = range(1, 7)
_CODES[list(b"(,):;")] = [_OPEN, _COMMA, _CLOSE, _COLON, _END]
_AROUND = re.compile(r"\s*([(),:;])\s*")


def _sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    lengths = end - start
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    at = np.repeat(start - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at].tobytes()))


def parse_arrays(text: str) -> tuple[np.ndarray, pa.Array, pa.Array, int] | None:
    """What ``parse_newick`` gives, by passes over arrays; None for texts that need that one: quotes, comments, errors, odd forms.

    A bracket opens below the node before it, and what stands between two
    structural characters belongs to the node that the first of them begins or
    ends. Brackets are matched by their depth: in the order of (depth, place)
    commas and closing brackets follow their opening one.
    """
    if "'" in text or "[" in text or "]" in text:
        return None
    if any(c.isspace() for c in set(text)):
        text = _AROUND.sub(r"\1", text.strip())
        if any(c.isspace() and c != " " for c in set(text)):
            return None
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.flatnonzero(_CODES[data])
    ends = place[_CODES[data[place]] == _END]
    starts = np.concatenate(([0], ends + 1))
    starts = starts[(starts < len(data)) & (data[np.minimum(starts, max(len(data) - 1, 0))] != ord(";"))] if len(data) else starts[:0]
    if not len(starts):
        return None
    order = np.argsort(np.concatenate((2 * place + 1, 2 * starts)), kind="stable")
    kind = np.concatenate((_CODES[data[place]], np.full(len(starts), _START, np.uint8)))[order]
    begin = np.concatenate((place + 1, starts))[order]
    end = np.concatenate((np.concatenate((place, starts))[order][1:], [len(data)]))
    depth = np.cumsum((kind == _OPEN).astype(np.int64) - (kind == _CLOSE))
    level = depth + (kind == _CLOSE)
    before = np.concatenate(([0], kind[:-1]))
    opens, empty = kind == _OPEN, begin == end
    made = opens | (kind == _COMMA) | (kind == _START)
    fine = depth.min() >= 0 and depth[-1] == 0 and not depth[kind == _END].any() and not (level[kind == _COMMA] < 1).any()
    fine = fine and np.isin(before[opens], (_OPEN, _COMMA, _START)).all() and empty[np.flatnonzero(opens) - 1].all()
    if not fine or ((kind == _COLON) & ((before == _COLON) | (before == _END))).any():
        return None
    ids = np.cumsum(made) - 1
    n = int(ids[-1]) + 1
    within = np.flatnonzero(opens | (kind == _COMMA) | (kind == _CLOSE))
    within = within[np.argsort(level[within], kind="stable")]
    opener = np.zeros(len(kind), np.int64)
    opener[within] = within[np.maximum.accumulate(np.where(opens[within], np.arange(len(within)), 0))] if len(within) else 0
    above = ids[opener] - 1  # the node below which the bracket opens
    ancestors = np.where(kind == _START, ids, np.where(opens, ids - 1, above))[made]
    node = np.where(kind == _CLOSE, above, ids)
    colon = np.flatnonzero(kind == _COLON)
    node[colon] = node[colon - 1]
    label, length = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
    for which in (made, kind == _CLOSE):
        label[:, node[which]] = begin[which], end[which]
    length[:, node[colon]] = begin[colon], end[colon]
    try:
        numbers = _sliced(data, *length)
        numbers = pc.cast(pc.if_else(pc.equal(numbers, ""), pa.scalar(None, pa.string()), numbers), pa.float64())
    except pa.ArrowInvalid:
        return None
    return ancestors, pc.utf8_rtrim(_sliced(data, *label), characters=" "), numbers, len(starts)


def from_newick(
    texts: DataFrame | str,
    spark: SparkSession | None = None,
    *,
    allow_forest: bool | None = None,
    branch_length_dtype: str = "double",
    create_ancestor_list: bool = False,
    replace_unquoted: Mapping[str, str] | None = None,
) -> DataFrame:
    """Nodes of the trees in ``texts`` (columns tree_id and newick, or one text).

    Several trees in a text are a forest: refused if ``allow_forest`` is False,
    warned about if it is None.
    """
    single = isinstance(texts, str)
    if single:
        texts = (spark or SparkSession.active()).createDataFrame([(0, texts)], "tree_id long, newick string")
    swap = dict(replace_unquoted or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, text in zip(batch["tree_id"].to_pylist(), batch["newick"].to_pylist(), strict=True):
                ancestors, labels, lengths, trees = (None if swap else parse_arrays(text or "")) or parse_newick(text or "", swap)
                if trees > 1 and not allow_forest:
                    if allow_forest is False:
                        raise NewickError("several trees in a text")
                    warnings.warn("several trees in a text: a forest", stacklevel=2)
                n, delta = len(ancestors), lengths if isinstance(lengths, pa.Array) else pa.array(lengths, pa.float64())
                labels = labels if isinstance(labels, pa.Array) else pa.array(labels, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, tree)), pa.array(np.arange(n)), pa.array(ancestors, pa.int64()), labels, delta, delta],
                    ["tree_id", "id", "ancestor_id", "taxon_label", "origin_time_delta", "branch_length"],
                )

    schema = "tree_id long, id long, ancestor_id long, taxon_label string, origin_time_delta double, branch_length double"
    out = texts.select(F.col("tree_id").cast("long").alias("tree_id"), F.col("newick").cast("string").alias("newick")).mapInArrow(run, schema)
    if branch_length_dtype != "double":
        out = out.withColumns({c: F.col(c).cast(branch_length_dtype) for c in ("origin_time_delta", "branch_length")})
    if create_ancestor_list:
        out = out.withColumn("ancestor_list", make_ancestor_list(F.col("id"), F.col("ancestor_id")))
    return out.drop("tree_id") if single else out


def read_newick(spark: SparkSession, path: str, **options) -> DataFrame:
    """All Newick files at a path, a tree or forest each; ``tree_id`` by the files' names in order."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("newick"), F.col("_metadata.file_path").alias("file"))
    # Names are numbered without the texts.
    names = numbered(spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file")), ["file"], "tree_id")
    named = files.join(names, "file")
    return from_newick(named, **options)


def _number(x) -> F.Column:
    """A length as text: no trailing zeros, nothing for none."""
    value = x.cast("double")
    text = F.when(value == F.floor(value), F.when(F.abs(value) < 1e15, value.cast("long").cast("string"))).otherwise(None)
    return F.when(value.isNull() | F.isnan(value), "").otherwise(F.concat(F.lit(":"), F.coalesce(text, x.cast("string"))))


def as_newick(df: DataFrame, *, taxon_label: str | None = None, sep_forest: str = "\n", unsafe_symbols: str = UNSAFE_SYMBOLS) -> DataFrame:
    """One row ``newick`` a table (or tree_id); children by falling id, trees by falling root id's walk."""
    k = keys(df)
    if "origin_time_delta" not in df.columns:
        df = mark_origin_time_delta(df) if "origin_time" in df.columns else df.withColumn("origin_time_delta", F.lit(None).cast("double"))
        # A root has no branch of its own unless times say 0.
    label = F.coalesce(F.col(taxon_label).cast("string"), F.lit("")) if taxon_label else F.lit("")
    unsafe = F.length(F.translate(label, unsafe_symbols, "")) < F.length(label)
    quoted = F.when(unsafe, F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(label)
    named = df.select(*k, "id", "ancestor_id", F.concat(quoted, _number(F.col("origin_time_delta"))).alias("_text"))
    walked = euler(named, descending=True)
    # Before a node's text: the comma to its elder sister, and brackets down from the depth before.
    walked = numbered(walked, ["post"], "_before", lag_of="depth")
    gap = F.col("depth") - F.coalesce("_before", F.lit(0))
    starts = F.col("_before") == 0
    open_ = F.when(starts.isNull() | starts, F.lit("")).otherwise(F.lit(","))
    token = (
        F.when(gap < 0, F.concat(F.lit(")"), F.col("_text")))
        .when(starts.isNull() | starts, F.concat(F.repeat(F.lit("("), F.col("depth").cast("int")), F.col("_text")))
        .otherwise(F.concat(open_, F.repeat(F.lit("("), gap.cast("int")), F.col("_text")))
    )
    ended = F.when(is_root(), F.concat(token, F.lit(";"), F.lit(sep_forest))).otherwise(token)
    tokens = walked.withColumn("_token", ended)
    joined = tokens.groupBy(*k).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("post", "_token"))), lambda x: x["_token"]), "").alias("newick"))
    out = joined if k else joined.select(F.when(F.length("newick") == 0, F.lit(";" + sep_forest)).otherwise(F.col("newick")).alias("newick"))
    trimmed = F.expr(f"substring(newick, 1, length(newick) - {len(sep_forest)})") if sep_forest else F.col("newick")
    return out.withColumn("newick", trimmed)
