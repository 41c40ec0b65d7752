"""Ranked search: blocked exact and indexed vector top-k, blocked fuzzy names, rank fusion, content dedup."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.scalar import strip
from glyphmill.session import cut

#: Rows of one block of each side; a task holds one block of both at a time.
BLOCK = 2_048
#: Texts of one block of either side of the fuzzy search.
NAME_BLOCK = 8_192
#: Codes of one block of the vector index: sixteen bytes a row where a vector has hundreds.
CODE_BLOCK = 16_384
#: Rows the codebooks of the vector index are fitted on, at most; every row is indexed.
FIT_ROWS = 10_000


def _blocks(rows: DataFrame, key: str, value: str, count: int, name: str) -> DataFrame:
    """(name, keys, values): the rows in ``count`` blocks by a hash of the key, each as one row of arrays."""
    each = rows.select(F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias(name), F.struct(key, value).alias("r"))
    return each.groupBy(name).agg(F.array_sort(F.collect_list("r")).alias(f"{name}_rows"))


def _parts(n: int, block: int = BLOCK) -> int:
    return max(1, -(-n // block))


def _paired(asked: DataFrame, held: DataFrame, nq: int, nc: int) -> DataFrame:
    """Every block of a stated query set (q) beside every block of the corpus (c).

    The blocks have a bounded number of rows, and each pair of blocks is one row, so the work spreads over the cluster.
    """
    return held.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).join(asked, "q").repartition(max(nq * nc, 1), "q", "c")


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)  # a zero vector is near nothing


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return _unit(np.asarray(flat, dtype=np.float64).reshape(rows, -1))


def _vectors(vectors: DataFrame, key: str, value: str) -> tuple[DataFrame, int, int]:
    """The rows that can be compared, their number, and the length of most vectors: others, and vectors with a null, are left out."""
    rows = vectors.select(key, value).filter(F.col(value).isNotNull() & ~F.exists(value, lambda x: x.isNull()))
    size = rows.agg(F.mode(F.size(value), True)).first()[0] or 0
    rows = rows.filter(F.size(value) == size)
    return rows, rows.count(), size


def _vector_blocks(rows: DataFrame, key: str, value: str, count: int, name: str) -> DataFrame:
    """(name, name_ids, name_flat): the rows in ``count`` blocks, each as its ids and its vectors end to end."""
    blocks = _blocks(rows, key, value, count, name)
    held = F.col(f"{name}_rows")
    return blocks.select(name, F.transform(held, lambda r: r[key]).alias(f"{name}_ids"), F.flatten(F.transform(held, lambda r: r[value])).alias(f"{name}_flat"))


def _best(qs: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of a block for each query, ties to the smaller id; what is near nothing is left out."""
    d = np.where(np.isnan(d), np.inf, d)
    order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 9)), axis=1)[:, :k]
    out = pd.DataFrame({"query_id": np.repeat(qs, order.shape[1]), "vec_id": ids[order].ravel(), "distance": np.take_along_axis(d, order, 1).ravel()})
    return out[np.isfinite(out["distance"])]


_FOUND = "query_id bigint, vec_id bigint, distance double"


def _asked(vectors: DataFrame, rows: DataFrame, queries: DataFrame | None, every: int, key: str, value: str) -> tuple[DataFrame, int]:
    asked = rows.filter(F.pmod(F.col(key), F.lit(every)) == 0) if queries is None else _vectors(queries, key, value)[0]
    return asked, asked.count()


def vector_topk(vectors: DataFrame, k: int = 10, every: int = 50, key: str = "vec_id", value: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest rows by cosine distance of every row whose id ``every`` divides.

    Exact: all rows are compared in blocks, each block keeps its own k best, and a rank over those few decides. Ties go
    to the smaller id; a query's own row counts. Rows with a null vector, a null in it or another length than most are
    left out, zero vectors are near nothing. With ``queries``, a table of the same columns, every row of it is asked;
    what is found are rows of ``vectors`` alone, so a filter of ``vectors`` is a filter of what may be found. Calling it
    counts both sides.
    """
    rows, n_rows, _ = _vectors(vectors, key, value)
    asked, n_queries = _asked(vectors, rows, queries, every, key, value)

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, q, ids, c in zip(frame["q_ids"], frame["q_flat"], frame["c_ids"], frame["c_flat"]):
                yield _best(np.asarray(qs), np.asarray(ids), 1.0 - _matrix(q, len(qs)) @ _matrix(c, len(ids)).T, k)

    pairs = _paired(_vector_blocks(asked, key, value, _parts(n_queries), "q"), _vector_blocks(rows, key, value, _parts(n_rows), "c"), _parts(n_queries), _parts(n_rows))
    return _ranked(pairs.select("q_ids", "q_flat", "c_ids", "c_flat").mapInPandas(nearest, _FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def fit_codebooks(rows: DataFrame, parts: int, levels: int, value: str = "embedding", key: str = "vec_id", rounds: int = 6) -> list[np.ndarray] | None:
    """Codebooks of a product quantiser: for each part of a unit vector ``levels`` centres, by k-means on at most FIT_ROWS rows chosen by a hash of their ids."""
    sample = rows.select(value, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(FIT_ROWS).collect()
    if not sample:
        return None
    x = np.nan_to_num(_unit(np.array([r[value] for r in sample], dtype=np.float64)))
    books = []
    for part in np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1])):
        own = x[:, part]
        centres = own[np.linspace(0, len(own) - 1, min(levels, len(own))).astype(int)].copy()
        for _ in range(rounds):
            mine = np.argmin((centres**2).sum(1) - 2 * own @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, mine, own)
            n = np.bincount(mine, minlength=len(centres))[:, None]
            centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
        books.append(centres)
    return books


def vector_topk_indexed(vectors: DataFrame, k: int = 10, every: int = 50, parts: int = 16, levels: int = 256, candidates: int = 200, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``vector_topk`` through product quantisation: a row is ``parts`` bytes, the ``candidates`` best by codes are compared exactly.

    Every row is encoded; the codebooks are fitted on a bounded sample. Codes and queries meet in blocks of bounded size
    on both sides, where only codes are moved for the corpus; a second join fetches the vectors of the candidates.
    Approximate: the recall is measured in tests and by ``topk_recall``.
    """
    rows, n_rows, size = _vectors(vectors, key, value)
    books = fit_codebooks(rows, parts, levels, value, key)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, distance double")
    edges = np.cumsum([0, *[b.shape[1] for b in books]])

    @F.pandas_udf("binary")
    def code(v: pd.Series) -> pd.Series:
        x = np.nan_to_num(_matrix(np.concatenate(v.to_numpy()), len(v))) if len(v) else np.empty((0, size))
        nearest = [np.argmin((b**2).sum(1) - 2 * x[:, i:j] @ b.T, axis=1) for b, i, j in zip(books, edges, edges[1:])]
        return pd.Series([row.tobytes() for row in np.stack(nearest, axis=1).astype("uint8")])

    coded = _blocks(rows.withColumn("code", code(value)), key, "code", _parts(n_rows, CODE_BLOCK), "c")
    coded = coded.select("c", F.transform("c_rows", lambda r: r[key]).alias("c_ids"), F.transform("c_rows", lambda r: r["code"]).alias("c_codes"))
    asked, n_queries = _asked(vectors, rows, None, every, key, value)
    pairs = _paired(_vector_blocks(asked, key, value, _parts(n_queries), "q"), coded, _parts(n_queries), _parts(n_rows, CODE_BLOCK))

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, q, ids, codes in zip(frame["q_ids"], frame["q_flat"], frame["c_ids"], frame["c_codes"]):
                each = np.frombuffer(b"".join(codes), np.uint8).reshape(len(ids), len(books))
                told = np.concatenate([b[each[:, j]] for j, b in enumerate(books)], axis=1)
                yield _best(np.asarray(qs), np.asarray(ids), 1.0 - _matrix(q, len(qs)) @ told.T, candidates)

    near = _ranked(pairs.select("q_ids", "q_flat", "c_ids", "c_codes").mapInPandas(likely, _FOUND), candidates)

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (_matrix(np.concatenate(v.to_numpy()), len(v)) for v in (a, b))
        return pd.Series(1.0 - (x * y).sum(axis=1))

    pairs = near.select("query_id", F.col("vec_id").alias("near_id")).join(rows.select(F.col(key).alias("near_id"), F.col(value).alias("_held")), "near_id").join(asked.select(F.col(key).alias("query_id"), F.col(value).alias("_asked")), "query_id")
    exact = pairs.select("query_id", F.col("near_id").alias("vec_id"), distance("_asked", "_held").alias("distance")).filter(~F.isnan("distance"))
    return _ranked(exact, k)


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times the normalised insertion-deletion similarity; two empty texts are alike."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


#: Letters are counted in this many groups; a shared group only loosens the bound.
_GROUPS = 64
#: Queries that are compared with a block of names at once, pairs whose subsequences are worked out at once, and the length beyond which a text is compared alone.
TOGETHER, PAIRS, LONG = 128, 8_192, 1_024


def _points(texts: list[str]) -> np.ndarray:
    """The code points of the texts, end to end."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))


def _letters(names: list[str]) -> np.ndarray:
    lengths = _lengths(names)
    at = np.repeat(np.arange(len(names)), lengths) * _GROUPS + _points(names).astype(np.int64) * 37 % _GROUPS
    return np.bincount(at, minlength=len(names) * _GROUPS).reshape(-1, _GROUPS)


def most_alike(query: str, names: list[str], letters: np.ndarray, lengths: np.ndarray, score: float, best: int) -> list[tuple[float, str]]:
    """The ``best`` names most like the query, of at least ``score``, as (score, name), ties by name.

    No two texts have a longer common subsequence than letters in common, which bounds the score; names are looked at
    in the order of that bound until it falls below the score, or below the least of the best found. Nothing is lost.
    """
    bound = 200.0 * np.minimum(letters, _letters([query])).sum(axis=1) / (lengths + len(query))
    found: list[tuple[float, str]] = []
    for i in np.argsort(-bound, kind="stable"):
        least = max(score, -found[best - 1][0]) if len(found) >= best else score
        if bound[i] < least - 1e-9:
            break
        ratio = indel_ratio(query, names[i])
        if ratio >= score:
            insort(found, (-ratio, names[i]))
    return [(-r, name) for r, name in found[:best]]


def _steps(letters: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A column for each group and number up to the group's ``most``, 1 where a text has so many: the product of two texts' rows is their letters in common."""
    group = np.repeat(np.arange(_GROUPS), most)
    number = np.arange(len(group)) - np.repeat(np.cumsum(most) - most, most) + 1
    return (letters[:, group] >= number).astype(np.float32)


def _coded(texts: list[str], alphabet: np.ndarray) -> np.ndarray:
    """(place, text): letters as their place in the alphabet from 1; 0 for others and beyond the end."""
    lengths, points = _lengths(texts), _points(texts)
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    out = np.zeros((len(texts), lengths.max()), np.uint8 if len(alphabet) < 256 else np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.where(alphabet[at] == points, at + 1, 0)
    return np.ascontiguousarray(out.T)


def _masks(codes: np.ndarray, letters: int) -> np.ndarray:
    """(word, text * letters + letter): bits of the places where a text has a letter, 64 places a word."""
    out = np.zeros((_parts(len(codes), 64), codes.shape[1], letters), np.uint64)
    for i, letter in enumerate(codes):
        out[i // 64, np.arange(codes.shape[1]), letter] |= np.uint64(1 << i % 64)
    out[:, :, 0] = 0
    return out.reshape(len(out), -1)


def _subsequences(masks: np.ndarray, letters: int, codes: np.ndarray, lengths: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``lcs_length`` of the pairs of query q and name n, many at once: a carry goes from word to word of long queries."""
    out = np.empty(len(q), np.int64)
    for i in range(0, len(q), PAIRS):
        first, other = q[i : i + PAIRS] * letters, n[i : i + PAIRS]
        rows = np.full((len(masks), len(first)), ~np.uint64(0))
        at, hit, total = np.empty_like(first), np.empty_like(rows[0]), np.empty_like(rows[0])
        for letter in codes[: lengths[other].max()]:
            np.add(first, letter.take(other), out=at)
            carry = None
            for mask, row in zip(masks, rows):
                np.take(mask, at, out=hit, mode="clip")
                np.bitwise_and(row, hit, out=hit)
                np.add(row, hit, out=total)
                if len(masks) > 1:
                    over = total < row
                    if carry is not None:
                        np.add(total, carry, out=total)
                        over |= total < carry
                    carry = over.astype(np.uint64)
                np.subtract(row, hit, out=row)
                np.bitwise_or(row, total, out=row)
        out[i : i + PAIRS] = 64 * len(masks) - np.bitwise_count(rows).sum(axis=0, dtype=np.int64)
    return out


def _first(q: np.ndarray, n: np.ndarray, scores: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs the ``best`` of each query, by score and then by name."""
    order = np.lexsort((n, -scores, q))
    q, n, scores = q[order], n[order], scores[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < best
    return q[kept], n[kept], scores[kept]


def most_alike_of_each(queries: list[str], floors: list[float], names: list[str], best: int) -> list[tuple[str, str, float]]:
    """``most_alike`` of many queries, each with its own least score, as (query, name, score).

    Queries and names go by length, and only lengths that can reach the score meet. There the bound is one product of
    matrices, and the subsequences of all pairs that it lets pass are worked out together. Where it lets most pass, the
    pairs of the highest bound are worked out first, and the least of a query's best of them is its score. Nothing is lost.
    """
    out: list[tuple[str, str, float]] = []
    long = [x for x in names if len(x) > LONG]
    for some, others in ((queries, long), ([x for x in queries if len(x) > LONG], [x for x in names if len(x) <= LONG])):
        if some and others:
            letters, lengths, least = _letters(others), _lengths(others), dict(zip(queries, floors))
            out += [(x, name, s) for x in some for s, name in most_alike(x, others, letters, lengths, least[x], best)]
    asked, names = sorted((len(x), x, f) for x, f in zip(queries, floors) if 0 < len(x) <= LONG), sorted(x for x in names if 0 < len(x) <= LONG)
    if not asked or not names:
        return out
    queries, floors = [x for _, x, _ in asked], np.array([f for *_, f in asked], np.float64)
    place = np.argsort(_lengths(names), kind="stable")  # names in the order of their lengths; place is the order of the names themselves
    named = np.array(names, object)
    names = list(named[place])
    sizes, held, mine, theirs = _lengths(queries), _lengths(names), _letters(queries), _letters(names)
    alphabet = np.unique(_points(queries))
    codes, letters = _coded(names, alphabet), len(alphabet) + 1
    most = np.minimum(mine.max(axis=0), theirs.max(axis=0))
    steps = np.concatenate([_steps(theirs, most), np.ones((len(held), 1), np.float32), held[:, None].astype(np.float32)], axis=1)
    for i in range(0, len(queries), TOGETHER):
        own, size, floor = queries[i : i + TOGETHER], sizes[i : i + TOGETHER], floors[i : i + TOGETHER]
        share = np.clip(floor, 1e-6, 101) / 200  # of both lengths together
        a, b = np.searchsorted(held, (size * share / (1 - share)).min() - 1e-6), np.searchsorted(held, (size * (1 - share) / share).max() + 1e-6, "right")
        if a >= b:
            continue
        both = lambda q, n: size[q] + held[n]
        masks = _masks(_coded(own, alphabet), letters)
        scored = lambda q, n: 200.0 * _subsequences(masks, letters, codes, held, q, n) / both(q, n)
        # letters in common, less those that the score asks for; rounding can take no more than ``slack``
        near = np.concatenate([_steps(mine[i : i + TOGETHER], most), np.stack([-share * size, -share], axis=1).astype(np.float32)], axis=1) @ steps[a:b].T
        slack = float(2e-7 * steps.shape[1] * (size.max() + held[b - 1]))
        at = np.flatnonzero(near >= -slack)
        if len(at) > near.size // 16 and b - a > 8 * best:
            likely = 200.0 * (near + slack) / (size[:, None] + held[a:b]) + 200.0 * share[:, None]
            top = np.argpartition(-likely, 4 * best, axis=1)[:, : 4 * best]
            seen = scored(np.repeat(np.arange(len(own)), top.shape[1]), top.ravel() + a).reshape(top.shape)
            at = np.flatnonzero(likely >= np.maximum(floor, np.sort(seen, axis=1)[:, -best])[:, None] - 1e-6)
        q, n = at // (b - a), at % (b - a) + a
        scores = scored(q, n)
        kept = scores >= floor[q]
        q, n, scores = _first(q[kept], place[n[kept]], scores[kept], best)
        out += zip(np.array(own, object)[q], named[n], scores.tolist())
    return out


def _texts(rows: DataFrame, columns: list[str], count: int, name: str) -> DataFrame:
    """(name, and an array for each column): the rows in ``count`` blocks by a hash of their name."""
    each = rows.select(F.pmod(F.xxhash64("name"), F.lit(count)).cast("int").alias(name), F.struct(*columns).alias("r"))
    return each.groupBy(name).agg(F.collect_list("r").alias("r")).select(name, *[F.col(f"r.{c}").alias(f"{name}_{c}") for c in columns])


def fuzzy_names(names: DataFrame, queries: DataFrame, score: float = 70.0, best: int = 5, within: str | None = None, floor: str | None = None) -> DataFrame:
    """(query, rank, name, score): the ``best`` names most like each query, of at least ``score``.

    Both sides have one column ``name``; they are made distinct in lower case without ``()``, nulls and blanks left
    out. The stated queries meet all names in blocks; within a block only names that the letters in common let reach
    the score are compared, which loses none. With ``within``, a text column of both sides that the result has too, only
    names of a query's own value are compared, nulls with none. With ``floor``, a number column of the queries, a query
    asks for at least that score if it is higher, and for the least of them if it stands there more than once. Calling
    it writes both sides to the checkpoint folder.
    """
    name = F.lower(F.replace(strip(F.col("name")), F.lit("()"), F.lit(""))).alias("name")
    plain = lambda d, *more: d.select(name, (F.col(within) if within else F.lit("")).alias("v"), *more).filter("name != '' AND v IS NOT NULL")
    least = F.greatest(F.lit(float(score)), F.col(floor).cast("double")) if floor else F.lit(float(score))
    corpus, asked = cut(plain(names).distinct()), cut(plain(queries, least.alias("least")).groupBy("name", "v").agg(F.min("least").alias("least")))
    nq, nc = _parts(asked.count(), NAME_BLOCK), _parts(corpus.count(), NAME_BLOCK)
    pairs = _paired(_texts(asked, ["name", "v", "least"], nq, "q"), _texts(corpus, ["name", "v"], nc, "c"), nq, nc)

    def alike(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qs, q_v, least, cs, c_v in zip(frame["q_name"], frame["q_v"], frame["q_least"], frame["c_name"], frame["c_v"]):
                asked, others = {}, {}
                for q, v, f in zip(qs, q_v, least):
                    asked.setdefault(v, []).append((q, f))
                for c, v in zip(cs, c_v):
                    others.setdefault(v, []).append(c)
                for v in asked.keys() & others.keys():
                    found = most_alike_of_each(*map(list, zip(*asked[v])), others[v], best)
                    yield pd.DataFrame([(q, v, n, s) for q, n, s in found], columns=["query", "v", "name", "score"])

    found = pairs.drop("q", "c").mapInPandas(alike, "query string, v string, name string, score double")
    order = Window.partitionBy("query", "v").orderBy(F.desc("score"), "name")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("query", *([F.col("v").alias(within)] if within else []), "rank", "name", F.round("score", 6).alias("score"))


def content_dedup(rows: DataFrame, text: str, rank: str, distance: str | None = None, limit: float = 0.7, prefix: int = 120, keep: list[str] | None = None) -> DataFrame:
    """The first row per beginning of the text, by ``rank``; the distance cut comes after, so a far first copy hides a nearer one.

    Only a digest of the beginning and the columns to ``keep`` (all of them by default) are shuffled.

    The comparison key is the lower-case beginning by design of the operator; the text itself stays whole.
    """
    key = F.lower(strip(F.substring(F.coalesce(text, F.lit("")), 1, prefix)))
    first = rows.withColumn("_key", F.md5(key)).groupBy("_key").agg(F.min_by(F.struct(*(keep or rows.columns)), F.col(rank)).alias("_row")).select("_row.*")
    return first.filter(F.col(distance) < limit) if distance else first


def fuse(vector_hits: DataFrame, name_hits: DataFrame, n: int | None = None) -> DataFrame:
    """(query_id, place, id, distance): name hits before vector hits, the first n, or all.

    vector_hits: query_id, rank, id, distance. name_hits: query_id, score, seen, id. Name hits come by score and order
    seen; a hit the vectors have too keeps its distance, another gets 0.01. A query without vector hits has no rows.
    """
    has = vector_hits.select("query_id").distinct()
    named = name_hits.join(has, "query_id", "left_semi").withColumn("name_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen", "id")))
    both = vector_hits.join(named.select("query_id", "id", "name_rank"), ["query_id", "id"], "full_outer")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("name_rank").isNull(), "name_rank", "rank"))
    fused = both.withColumn("place", place).select("query_id", "place", "id", F.coalesce("distance", F.lit(0.01)).alias("distance"))
    return fused.filter(F.col("place") <= n) if n else fused


def interleave(hits: DataFrame, supplement: DataFrame, wanted: tuple = ("function", "variable", "type", "constant")) -> DataFrame:
    """(query_id, place, id): where the first three hits have no wanted category, supplements go behind the first hit.

    hits and supplement: query_id, rank, id, category.
    """
    top = hits.filter("rank <= 3").groupBy("query_id").agg(F.max(F.col("category").isin(*wanted)).alias("has"))
    lacking = top.filter("NOT has").select("query_id")
    extra = supplement.join(lacking, "query_id", "left_semi").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "rank", "id", F.lit(1).alias("tier"))
    own = hits.select("query_id", "rank", "id", F.when(F.col("rank") == 1, 0).otherwise(2).alias("tier"))
    return own.unionByName(extra).select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank", "id")).alias("place"), "id")


def distinct_examples(examples: Column, prefix: int = 120) -> Column:
    """Examples whose beginnings differ apart from white space and case; of equal ones the one with most lines stays.

    The order is that of first sight; a later one replaces only with strictly more lines.
    """
    key = lambda e: F.substring(F.lower(F.regexp_replace(e, r"\s+", "")), 1, prefix)
    lines = lambda e: F.length(e) - F.length(F.replace(e, F.lit("\n"), F.lit("")))
    known = F.filter(F.coalesce(examples, F.array().cast("array<string>")), lambda e: e.isNotNull())
    keys = F.array_distinct(F.transform(known, key))
    return F.transform(
        keys,
        lambda k: F.reduce(F.filter(known, lambda e: key(e) == k), F.lit(None).cast("string"), lambda best, e: F.when(best.isNull() | (lines(e) > lines(best)), e).otherwise(best)),
    )
