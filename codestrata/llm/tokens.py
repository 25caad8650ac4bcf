"""Token ids of whole texts with a public byte-level vocabulary, by tree concatenation.

A text is halved, wherever its middle lies, until its parts are short; the parts are encoded side by side, and at each
join a window that grows on both sides is encoded anew until it agrees exactly with what stands left and right of it.
"""

from __future__ import annotations

import base64
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import environment_path, spread

#: Path of the vocabulary (ranks). A parameter; never copied into the repository.
RANKS = environment_path("CODESTRATA_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Split rule of the vocabulary; a fixed value of its public description.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts above so many code points are halved; those above SPREAD are encoded by many tasks.
LEAF, SPREAD = 1 << 10, 1 << 16
#: Code points on each side of a join in the first window.
WINDOW = 8
#: Code points of one class on both sides of a join from which the join is settled by tokens.
UNSPLIT = 1 << 10
#: Two neighbours between which the split rule ends a piece, whatever stands around: pieces begin with white space at most,
#: have characters of one class behind it, and an apostrophe stands with letters only before them.
BORDER = r"\p{L}\P{L}|\p{N}\P{N}|[^\s\p{L}\p{N}]\s"
ONE_CLASS = r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {r: b for b, r in encoder(path)._mergeable_ranks.items()}


def piece_ids(piece: bytes, path: str) -> list[int]:
    """Ids of bytes without a split rule: what the merges make of one unsplit piece."""
    return encoder(path)._encode_single_piece(piece)


@lru_cache(maxsize=1)
def _rules():
    import regex

    return regex.compile(BORDER), regex.compile("(?r)" + BORDER), regex.compile(ONE_CLASS)


def halves(text: str, size: int = LEAF) -> list[str]:
    """Parts of a text in order: halved, wherever the middle lies, until none has more than ``size`` code points."""
    if len(text) <= size:
        return [text]
    mid = len(text) // 2
    return halves(text[:mid], size) + halves(text[mid:], size)


def _held(ids: list[int], n_bytes: int, names: dict[int, bytes], last: bool) -> int:
    """How many tokens of the end (or the beginning) hold ``n_bytes`` bytes."""
    k = have = 0
    while have < n_bytes:
        k += 1
        have += len(names[ids[-k] if last else ids[k - 1]])
    return k


Part = tuple[str, list[int]]


def joined(left: Part, right: Part, path: str, window: int = WINDOW, unsplit: int = UNSPLIT) -> Part:
    """Two neighbouring parts of a text, each with its ids, as one part with the ids of the whole.

    The window around the join begins and ends at a border of the split rule, at least ``window`` code points away on
    either side. A border is one in the part and in the whole, so what lies beyond it stays as it is, and the window encoded
    anew takes the place of the tokens between. It grows, to the whole at most, until its first and last token are
    those that stood there before. Within a long unsplit piece, which has no border, ``joined_piece`` does the same by tokens.
    """
    (a, x), (b, y) = left, right
    if not a or not b:
        return a + b, x + y
    after, before, one = _rules()
    names, enc = _bytes_of(path), encoder(path)
    k = window
    while True:
        if k >= unsplit and len(a) > k < len(b) and one.fullmatch(a[-k:] + b[:k]):
            whole = joined_piece(x, y, len(a[-k:].encode()), len(b[: k - 1].encode()), path)
            if whole is not None:
                return a + b, whole
        m = before.search(a, 0, max(0, len(a) - k + 1))
        lo = m.start() + 1 if m else 0
        m = after.search(b, k - 1)
        hi = m.start() + 1 if m else len(b)
        u = _held(x, len(a[lo:].encode()), names, True)
        v = _held(y, len(b[:hi].encode()), names, False)
        anew = enc.encode_ordinary(a[lo:] + b[:hi])
        if (not lo or anew[0] == x[-u]) and (hi == len(b) or anew[-1] == y[v - 1]):
            return a + b, x[: len(x) - u] + anew + y[v:]
        k *= 2


def joined_piece(x: list[int], y: list[int], left_bytes: int, right_bytes: int, path: str) -> list[int] | None:
    """The ids across a join within one unsplit piece, of which so many bytes lie on either side; None if they are too few.

    A sequence of tokens is what the merges make of its bytes if every two neighbours are what the merges make of
    theirs. So a window of tokens around the join is encoded anew and doubled until its first and last token are
    those that stood there before: then all neighbours, inside and at both edges, agree, and the rest stays as it is.
    """
    names = _bytes_of(path)
    k = 2
    while True:
        p, q = b"".join(names[t] for t in x[-k:]), b"".join(names[t] for t in y[:k])
        if len(p) > left_bytes or len(q) > right_bytes:
            return None
        anew = piece_ids(p + q, path)
        if anew[0] == x[-k] and anew[-1] == y[k - 1]:
            return x[:-k] + anew + y[k:]
        k *= 2


def tree_joined(parts: list[Part], path: str) -> list[int]:
    """Parts in order to the ids of the text, joined pairwise, level by level."""
    while len(parts) > 1:
        parts = [joined(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0][1]


def _lists(rows: list[list[int]]):
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.fromiter((t for r in rows for t in r), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, leaf: int = LEAF, spread_above: int = SPREAD) -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``.

    Every text above ``leaf`` code points is halved and joined; up to ``spread_above`` in one narrow pass, beyond it with its
    parts spread over the cluster, where they are encoded in parallel and meet again for their joins, which is one row of
    the result. Every row stays, repeated ids too: rows are told apart by a number of their own.

    Null and empty text give an empty list. Text that looks like a special token is plain text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    long = F.length("_text") > spread_above

    def short_ids(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            ids = [tree_joined([(part, enc.encode_ordinary(part)) for part in halves(t, leaf)], path) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], names=["_id", "ids"])

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for row, i, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                parts = halves(text, spread_above // 2)
                for at in range(0, len(parts), 64):
                    yield pa.RecordBatch.from_pylist([{"_row": row, "_id": i, "n": at + n, "part": part} for n, part in enumerate(parts[at : at + 64])], schema=cut_schema)

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    cut_schema = pa.schema([("_row", pa.int64()), ("_id", to_arrow_type(rows.schema["_id"].dataType)), ("n", pa.int32()), ("part", pa.string())])

    def part_ids(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            ids = [tree_joined([(part, enc.encode_ordinary(part)) for part in halves(t, leaf)], path) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(ids)], names=["_row", "_id", "n", "part", "ids"])

    def whole(pdf):
        pdf = pdf.sort_values("n")
        ids = tree_joined([(t, list(map(int, x))) for t, x in zip(pdf["part"], pdf["ids"], strict=True)], path)
        return pdf.iloc[:1][["_id"]].assign(ids=[ids])

    rows = spread(rows)
    short = rows.where(~long).mapInArrow(short_ids, f"_id {kind}, ids array<int>")
    # the row number must not change between attempts, as it would if computed again after a shuffle; here it
    # follows from the scan's own partitions
    marked = rows.where(long).select(F.monotonically_increasing_id().alias("_row"), "_id", "_text")
    parts = marked.mapInArrow(cut, f"_row long, _id {kind}, n int, part string").repartition("_row", "n")
    encoded = parts.mapInArrow(part_ids, f"_row long, _id {kind}, n int, part string, ids array<int>")
    longs = encoded.groupBy("_row").applyInPandas(whole, f"_id {kind}, ids array<int>")
    return short.unionByName(longs).select(F.col("_id").alias(id_col), "ids")
