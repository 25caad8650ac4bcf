"""Evaluation texts inside training text: latent semantic retrieval of passages, then exact runs and a paraphrase check.

Passages of both sides become TF-IDF vectors over hashed words, a randomised SVD gives the latent space, passages
near an item's passage in that space are candidates, and each candidate is settled on the words themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import checkpointed, spread

#: Words in a run that counts as a leak.
RUN = 20
#: Corpus passages have WIDTH words and begin every STEP words. Any RUN consecutive words hold a whole passage,
#: as STEP + WIDTH - 1 <= RUN; item passages begin at every word, so that passage has its exact twin among them.
WIDTH, STEP = 10, 11
#: Buckets of hashed words, rank and oversampling of the SVD, number of power iterations.
BUCKETS, RANK, OVERSAMPLE, POWER = 1 << 14, 48, 8, 2
#: Passages on which the latent space is fitted, at most; every row is searched in it.
FIT_PASSAGES = 200_000
#: Cosine from which a passage is a candidate. Twins have 1; paraphrases with a few words replaced have less.
COSINE = 0.9
#: Cells of the index and cells probed for a passage.
CELLS, PROBES = 192, 3
#: Part of an item's words, in order, that a paraphrase holds, and of its identifiers and numbers.
PARAPHRASE, ANSWERS = 0.7, 0.5
#: Words of items in one index, which is broadcast (about 250 bytes a word); more items are searched block by block.
ITEM_WORDS = 400_000
SEED = 20231

# Each character of these scripts (Han, Hiragana, Katakana) is a word of its own.
_SINGLE = "\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3041-\u3096\u309d-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[{_SINGLE}](?<=\w)|[^\W_{_SINGLE}]+")


def words(text: str | None) -> list[str]:
    """Lower-cased longest runs of letters or digits; Chinese and Japanese characters stand alone."""
    return _WORDS.findall(text.lower()) if text else []


class _Buckets(dict):
    """Word to hashed number, the same on every machine; computed once while it is kept."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        b = self[word] = xxhash.xxh32_intdigest(word, SEED) % BUCKETS
        return b


_BUCKET_OF = _Buckets()


def buckets(ws: list[str]):
    import numpy as np

    return np.fromiter(map(_BUCKET_OF.__getitem__, ws), dtype=np.int32, count=len(ws))


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(bucket, n): in how many passages of the corpus, all rows, each hashed word stands. Summed per batch first."""

    def count(batches):
        import numpy as np
        import pandas as pd

        total = np.zeros(BUCKETS + 1, dtype=np.int64)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                parts = [passages(buckets(words(t))) for t in pdf["text"].tolist()[at : at + 1024]]
                rows = np.sort(np.concatenate(parts), axis=1)
                once = np.ones(rows.shape, dtype=bool)
                once[:, 1:] = rows[:, 1:] != rows[:, :-1]
                total[:BUCKETS] += np.bincount(rows[once], minlength=BUCKETS)
                total[BUCKETS] += len(rows)
        nz = np.nonzero(total)[0]
        yield pd.DataFrame({"bucket": nz, "n": total[nz]})

    src = spread(docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()))
    return src.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def passages(b, step: int = STEP):
    """Rows of WIDTH hashed words; a shorter text is no passage, since it can't hold a run."""
    import numpy as np

    if len(b) < WIDTH:
        return np.empty((0, WIDTH), dtype=np.int32)
    return np.lib.stride_tricks.sliding_window_view(b, WIDTH)[::step]


def vectors(rows, idf, basis):
    """Unit vectors of passages in the latent space and the part of their TF-IDF length that lies in it.

    A passage's TF-IDF row is never built: the projection is the sum of its words' rows of ``basis``, each with
    weight idf for each time it stands there.
    """
    import numpy as np

    w = idf[rows]
    z = np.einsum("pw,pwk->pk", w, basis[rows], optimize=True).astype(np.float32)
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return z / np.maximum(n, 1e-12)


def fit_sample(docs: DataFrame, text_col: str, n_rows: int, items: DataFrame) -> DataFrame:
    """(text, step): what the space is fitted on: all items, and texts of the corpus with FIT_PASSAGES passages at most.

    It stands in the checkpoint folder, since each round of the fit reads it.
    """
    share = min(1.0, FIT_PASSAGES / max(1, n_rows))
    src = docs.select(F.col(text_col).alias("text"), F.lit(STEP).alias("step")).where(F.col("text").isNotNull())
    if share < 1:
        src = src.where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1_000_000)) < int(share * 1_000_000))
    return checkpointed(src.unionByName(items.select(F.col(text_col).alias("text"), F.lit(1).alias("step")).where(F.col("text").isNotNull())))


def fit_space(sample: DataFrame, idf):
    """Basis (BUCKETS x RANK) of the latent space by distributed randomised SVD of TF-IDF passages.

    The matrix A (passages x words) stays in its partitions. A Gaussian test matrix G (words x rank + oversample)
    goes out, each partition sends back its part of A^T A G, the parts are added by word in the cluster, and the
    driver orthonormalises words x rank numbers, a size that no corpus changes. POWER rounds sharpen the range; the
    last projected covariance gives the singular directions. The rows of A are those of ``fit_sample``; counts and search
    cover all rows.
    """
    import numpy as np

    rng = np.random.default_rng(SEED)
    src = spread(sample)
    k = RANK + OVERSAMPLE
    q = rng.standard_normal((BUCKETS, k)).astype(np.float32)
    sc = sample.sparkSession.sparkContext
    for r in range(POWER + 1):
        sent = sc.broadcast((q, idf))

        def part(batches, sent=sent):
            import pyarrow as pa

            g, weights = sent.value
            total = np.zeros((BUCKETS, k), dtype=np.float32)
            used = False
            for batch in batches:
                rows = [passages(buckets(words(t)), step) for t, step in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
                rows = np.concatenate(rows) if rows else np.empty((0, WIDTH), dtype=np.int32)
                used = _add(total, rows, weights, g) or used
            if used:
                nz = np.nonzero(np.abs(total).sum(axis=1))[0]
                for at in range(0, len(nz), 2048):
                    ids = nz[at : at + 2048]
                    offsets = pa.array(np.arange(0, len(ids) * k + 1, k, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(total[ids].ravel()))], names=["bucket", "v"])

        parts = src.mapInArrow(part, "bucket long, v array<float>")
        sums = parts.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"x{i}") for i in range(k)])
        y = np.zeros((BUCKETS, k), dtype=np.float32)
        table = sums.toArrow()  # words x rank at most
        for i in range(k):
            y[table.column("bucket").to_numpy(), i] = table.column(f"x{i}").to_numpy()
        sent.unpersist()
        if r < POWER:
            q = np.linalg.qr(y)[0].astype(np.float32)
    # y = C q with C = A^T A; its compression to the range has the singular directions
    small = q.T @ y
    values, turn = np.linalg.eigh((small + small.T) / 2)
    top = turn[:, np.argsort(values)[::-1][:RANK]]
    return (q @ top).astype(np.float32)


def _add(total, rows, idf, g) -> bool:
    """Add A^T A G of passages ``rows`` to ``total``, in blocks."""
    import numpy as np

    for at in range(0, len(rows), 4096):
        block = rows[at : at + 4096]
        w = idf[block]
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        w = w / np.maximum(norm, 1e-9)
        ag = np.einsum("pw,pwk->pk", w, g[block], optimize=True)
        flat = block.ravel()
        back = (w[:, :, None] * ag[:, None, :]).reshape(-1, g.shape[1])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        starts = np.nonzero(np.r_[True, flat[1:] != flat[:-1]])[0]
        total[flat[starts]] += np.add.reduceat(back[order], starts, axis=0)
    return len(rows) > 0


@dataclass
class ItemIndex:
    """Item passages in the latent space, sorted into cells; bounded by ITEM_WORDS words."""

    ids: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    answers: list = field(default_factory=list)
    idf: object = None
    basis: object = None
    centres: object = None
    vecs: object = None
    owner: object = None
    at: object = None
    bounds: object = None
    rows: object = None
    lengths: object = None


def build_index(items: list[tuple[int, list[str]]], idf, basis) -> ItemIndex:
    """All item passages, in the cells of a short k-means over them."""
    import numpy as np

    ix = ItemIndex(idf=idf, basis=basis)
    ix.ids = [i for i, _ in items]
    ix.texts = [w for _, w in items]
    ix.answers = [{x for x in w if any(c.isdigit() for c in x) or len(x) > 9} for w in ix.texts]
    rows, owner, at = [], [], []
    for n, (_, w) in enumerate(items):
        p = passages(buckets(w), 1)
        rows.append(p)
        owner.append(np.full(len(p), n, dtype=np.int32))
        at.append(np.arange(len(p), dtype=np.int32))
    if not rows:
        rows, owner, at = [np.empty((0, WIDTH), np.int32)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    rows, owner, at = np.concatenate(rows), np.concatenate(owner), np.concatenate(at)
    vecs = np.concatenate([vectors(rows[i : i + 8192], idf, basis) for i in range(0, len(rows), 8192)]) if len(rows) else np.empty((0, RANK), np.float32)
    cells = max(1, min(CELLS, len(vecs) // 8))
    rng = np.random.default_rng(SEED)
    centres = vecs[rng.choice(len(vecs), cells, replace=False)] if len(vecs) else np.zeros((1, RANK), np.float32)
    for _ in range(6):
        cell = (vecs @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mine = vecs[cell == c]
            if len(mine):
                m = mine.mean(axis=0)
                centres[c] = m / max(1e-12, float(np.linalg.norm(m)))
    cell = (vecs @ centres.T).argmax(axis=1) if len(vecs) else np.empty(0, np.int64)
    order = np.argsort(cell, kind="stable")
    ix.centres, ix.vecs, ix.owner, ix.at = centres, vecs[order], owner[order], at[order]
    ix.bounds = np.searchsorted(cell[order], np.arange(len(centres) + 1))
    ix.rows, ix.lengths = rows[order], np.array([len(w) for w in ix.texts], dtype=np.int64)
    return ix


def candidates(ix: ItemIndex, vecs, cosine: float = COSINE):
    """(passage row, item passage) pairs whose cosine is at least ``cosine``, in the PROBES nearest cells."""
    import numpy as np

    if not len(vecs) or not len(ix.vecs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = vecs @ ix.centres.T
    probes = min(PROBES, near.shape[1])
    cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes].ravel()
    row = np.repeat(np.arange(len(vecs)), probes)
    order = np.argsort(cells, kind="stable")
    cells, row = cells[order], row[order]
    edges = np.searchsorted(cells, np.arange(len(ix.centres) + 1))
    a, b = [], []
    for c in range(len(ix.centres)):
        mine = row[edges[c] : edges[c + 1]]
        lo, hi = ix.bounds[c], ix.bounds[c + 1]
        if len(mine) and hi > lo:
            x, y = np.nonzero(vecs[mine] @ ix.vecs[lo:hi].T >= cosine)
            a.append(mine[x])
            b.append(y + lo)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def run_length(doc: list[str], p: int, item: list[str], q: int) -> int:
    """Length of the longest run of equal words through positions p and q; 0 if the words there differ."""
    if doc[p] != item[q]:
        return 0
    a = 0
    while a < p and a < q and doc[p - a - 1] == item[q - a - 1]:
        a += 1
    b = 1
    while p + b < len(doc) and q + b < len(item) and doc[p + b] == item[q + b]:
        b += 1
    return a + b


def common_words(doc: list[str], item: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors over the item's words."""
    where: dict[str, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    v = (1 << len(item)) - 1
    full = v
    for w in doc:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def settle(docs: list[list[str]], ix: ItemIndex, rows, doc, pos, a, b) -> list[tuple[int, int, str, int, float]]:
    """(text number, item number, kind, run, share) of the candidates: passage a[i] of the texts, item passage b[i].

    Twins (equal hashed words) are extended word by word to their whole run. Items without a run of RUN words whose
    candidate passages lie along one diagonal for a part of the item are compared by their longest common
    subsequence with the text around and by their identifiers and numbers (the answers).
    """
    import numpy as np

    found: dict[tuple[int, int], int] = {}
    twins = np.nonzero((rows[a] == ix.rows[b]).all(axis=1))[0]
    for i in twins.tolist():
        key = (int(doc[a[i]]), int(ix.owner[b[i]]))
        if found.get(key, 0) < RUN:
            run = run_length(docs[key[0]], int(pos[a[i]]), ix.texts[key[1]], int(ix.at[b[i]]))
            found[key] = max(found.get(key, 0), run)
    out = [(*k, "verbatim", run, run / len(ix.texts[k[1]])) for k, run in found.items() if run >= RUN]
    # a diagonal is text and item, and where the item would begin in the text, give or take a few words
    if not len(a):
        return out
    begin = (pos[a] - ix.at[b] + 1024) // 16
    span = int(begin.max()) + 2
    line = (doc[a].astype(np.int64) * len(ix.texts) + ix.owner[b]) * span + begin
    both = np.concatenate([line, line - 1])  # a diagonal near a border counts on both sides
    once = np.unique(both * (len(rows) + 1) + np.concatenate([a, a]))  # each passage once on each diagonal
    keys, distinct = np.unique(once // (len(rows) + 1), return_counts=True)
    lines = np.stack([keys // span // len(ix.texts), keys // span % len(ix.texts), keys % span], axis=1)
    need = np.ceil(0.3 * ix.lengths[lines[:, 1]] / STEP)
    done: set[tuple[int, int]] = {(d, n) for d, n, *_ in out}
    for d, n, at in lines[distinct >= need].tolist():
        if (d, n) in done:
            continue
        item = ix.texts[n]
        start = at * 16 - 1024
        part = docs[d][max(0, start - 16) : max(0, start) + len(item) + 48]
        share = common_words(part, item) / len(item)
        kept = len(ix.answers[n] & set(part)) / len(ix.answers[n]) if ix.answers[n] else 1.0
        if share >= PARAPHRASE and kept >= ANSWERS:
            done.add((d, n))
            out.append((d, n, "paraphrase", found.get((d, n), 0), share))
    return out


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, kind, run, share) of every text and item that leaked into it.

    ``kind`` is verbatim (a run of at least RUN words in common, found with certainty: the run holds a corpus
    passage whose twin is an item passage, with cosine 1, and all items are in the fitted space) or paraphrase (found where
    the latent space brings the passages together). Null, empty and short texts have none. Repeated ids give repeated rows.
    The corpus is read once for counts, once for the sample that the space is fitted on, and once for each block of items;
    nothing of it is shuffled or gathered but counts by hashed word and that sample.

    The items are the query set. Up to ITEM_WORDS words are one index; more are cut into blocks by a hash of their ids, and one
    block after the other is gathered, broadcast, searched, written to the checkpoint folder and dropped, so the driver
    and the executors hold one bounded index at a time.
    """
    import numpy as np

    spark = docs.sparkSession
    freq = document_frequencies(docs.select(F.col(text_col)), text_col).toArrow()  # at most BUCKETS + 1 rows
    n = np.zeros(BUCKETS + 1, dtype=np.float64)
    n[freq.column("bucket").to_numpy()] = freq.column("n").to_numpy()
    total = max(1.0, n[BUCKETS])
    idf = (np.log((1.0 + total) / (1.0 + n[:BUCKETS])) + 0.05).astype(np.float32)
    asked = items.where(F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("_id"), F.col(text_col).alias(text_col))
    basis = fit_space(fit_sample(docs, text_col, int(total), asked), idf)
    # a character is a word at most, so the lengths bound the words
    n_words = asked.agg(F.sum(F.greatest(F.size(F.split(text_col, r"\s+")), F.length(F.regexp_replace(text_col, r"[\x00-\x{2e7f}]", ""))))).first()[0] or 0
    n_blocks = max(1, -(-int(n_words) // ITEM_WORDS))
    src = spread(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()))
    out = None
    for k in range(n_blocks):
        mine = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("_id", F.lit(SEED)), F.lit(n_blocks)) == k)
        block = [(i, w) for i, t in mine.toLocalIterator() if len(w := words(t)) >= WIDTH]
        sent = spark.sparkContext.broadcast(build_index(block, idf, basis))

        def search(batches, sent=sent):
            import pandas as pd

            ix = sent.value
            for pdf in batches:
                out = []
                for lo in range(0, len(pdf), 512):
                    out += _search(ix, pdf["_id"].tolist()[lo : lo + 512], pdf["_text"].tolist()[lo : lo + 512])
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "run", "share"])

        found = src.mapInPandas(search, "doc_id long, item_id long, kind string, run int, share double")
        if n_blocks == 1:
            return found
        found = checkpointed(found)
        sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(ix: ItemIndex, ids: list, texts: list) -> list[tuple]:
    import numpy as np

    docs = [words(t) for t in texts]
    rows, owner = [], []
    for n, w in enumerate(docs):
        p = passages(buckets(w))
        rows.append(p)
        owner.append(np.full(len(p), n, dtype=np.int64))
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    first = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(docs)))]
    pos = (np.arange(len(rows)) - first[owner]) * STEP
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(rows), 8192):
        x, y = candidates(ix, vectors(rows[at : at + 8192], ix.idf, ix.basis))
        a.append(x + at)
        b.append(y)
    hits = settle(docs, ix, rows, owner, pos, np.concatenate(a), np.concatenate(b))
    return [(ids[d], ix.ids[n], kind, run, float(share)) for d, n, kind, run, share in hits]
