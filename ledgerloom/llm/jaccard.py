"""Operator 6, n-gram Jaccard join: exact, by a token-group matrix.

A document's set is its distinct word shingles (hashes). Documents with equal sets are one class. Two sets with a Jaccard similarity of
at least 3/4 share several tokens among the first of each in any common order (see prefixes); sets with fewer shared prefix tokens
are linked with nothing. Frequent tokens come last in the order, so a passage that many documents share counts little.

The others are partitioned into tiles of bounded size and searched there: groups of at most GROUP sets store the union of their tokens,
the table of (token, group) is the token-group matrix, which bounds what a query shares with any member of a group; only groups whose bound
reaches 3/4 of the query are opened and counted member by member, and not those whose members are in the query's component already.

A set meets one tile at a time. Rounds deal the sets by another token each (near copies have nearly all in common; one too large for a
tile is dealt anew by chance), and join what is linked to components. A prefix token that only one component or only one tile holds can make
no new link, so it goes, and with it every set left with fewer tokens than a link needs: after a round or two nearly all have gone. For what is left after
ROUNDS the matrix is applied to the tiles themselves: a set visits each tile that holds enough of its tokens in other components. So no
link is lost, and the last step is small.

Defined cases: null and empty texts have an empty set and are linked with nothing; with fewer than five words the whole sequence is
the one token; equal rows are one class; rows of one doc_id with different texts are judged apart; a null doc_id takes part and
names a component only when no other id can; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import sketch
from ledgerloom.llm.components import connected
from ledgerloom.llm.text import LOWER, MULT2, body, bucket_of, mix, pieces, rolling, utf8, word_hashes, word_spans
from ledgerloom.session import cut, drop, fresh

SHINGLE = 5
#: The order of tokens puts at most this many frequent ones last. It changes the work, never the result.
FREQUENT = 1 << 16
FREQUENT_IN_PIECE = 8
GROUP = 64
TILE_TOKENS = 500_000
#: Rounds in which a set meets one tile. The step after them finds what they leave: their number changes the work, never the result.
ROUNDS = 3
BUCKET_TOKENS = 1_500_000
FLUSH = 1_000_000
KNOWN = 65_536
#: A set of 2 ** 64 tokens would be in band 154.
BANDS = 255


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted tokens of all documents, end to end, and their len + 1 offsets."""
    raw, offsets = utf8(column)
    starts, ends, at = word_spans(raw, offsets)
    hashes = word_hashes(LOWER[raw] if len(raw) else raw, starts, ends)
    rolled = rolling(hashes, k)
    out, sizes = [], []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            tokens = np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            tokens = mix(rolling(hashes[lo:hi], hi - lo, MULT2)[:1] + np.uint64(hi - lo))
        else:
            tokens = hashes[:0]
        out.append(tokens)
        sizes.append(len(tokens))
    return np.concatenate(out) if out else hashes[:0], np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, as signed 64-bit numbers. The low BAND_BITS of the first are the set's size band: sets whose bands differ
    by more than one have sizes too unlike to be linked."""
    out = []
    sizes = np.diff(offsets)
    band = np.floor(np.log(np.maximum(sizes, 1)) / (np.log(4 / 3) + 1e-9)).astype(np.uint64)
    for salt in (1, 2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(tokens + np.uint64(salt * int(MULT2) % 2**64)))))
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return ((out[0].view(np.uint64) & ~np.uint64(BANDS)) | band).view(np.int64), out[1]


def measure(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """A row per document: id, row (hash of the text), n, s1, s2; and rows of frequent tokens: token, count."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row long, n long, s1 long, s2 long, token long, count long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            tokens, offsets = shingle_sets(batch.column(2))
            s1, s2 = set_ids(tokens, offsets)
            values, counts = np.unique(tokens, return_counts=True)
            often = counts >= FREQUENT_IN_PIECE
            values, counts, n = values[often].view(np.int64), counts[often], batch.num_rows
            gone, none = pa.nulls(len(values), pa.int64()), pa.nulls(n, pa.int64())
            ids = pa.concat_arrays([batch.column(0), pa.nulls(len(values), batch.column(0).type)])
            cols = [pa.concat_arrays([pa.array(x, pa.int64()), gone]) for x in (batch.column(1).to_numpy(), np.diff(offsets), s1, s2)]
            cols += [pa.concat_arrays([none, pa.array(x, pa.int64())]) for x in (values, counts)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "row", "n", "s1", "s2", "token", "count"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(body(text)).alias("row"), F.col(text).alias("text")).mapInArrow(run, schema)


def extra(n):
    """Tokens that the prefix is longer by, so that similar sets share more than one of them."""
    return 1 + 3 * n // 20


def prefixes(tokens: np.ndarray, offsets: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of each set in the common order, and the place of their set. frequent is sorted; rank gives its order.

    Sets of a and b tokens with a Jaccard similarity of 3/4 share at least ceil(3/4 max(a, b)) tokens, hence at least
    min(extra(a), extra(b)) of their prefixes of n - ceil(3n/4) + extra(n)."""
    place = np.zeros(len(tokens), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        place = np.where(frequent[at] == tokens, rank[at] + 1, 0)
    out, owner = [], []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        n = hi - lo
        if n:
            take = n + (-3 * n // 4) + extra(n)
            mine, late = tokens[lo:hi], place[lo:hi]
            if late.any():
                mine = mine[np.lexsort((mine, late))]
            out.append(mine[:take])
            owner.append(np.full(take, i))
    return (np.concatenate(out), np.concatenate(owner)) if out else (tokens[:0], np.zeros(0, np.int64))


def repeated(tokens: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, set) by token and size band, and whether their token is in another set of their band or the next."""
    band = sets & BANDS
    order = np.lexsort((sets, band, tokens))
    tokens, sets, band = tokens[order], sets[order], band[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (sets[1:] != sets[:-1])
    tokens, sets, band = tokens[new], sets[new], band[new]
    many = np.zeros(len(tokens), bool)
    near = (tokens[1:] == tokens[:-1]) & (band[1:] - band[:-1] <= 1)
    many[1:] |= near
    many[:-1] |= near
    return tokens, sets, many


def shared_tokens(docs: DataFrame, text: str, frequent: np.ndarray, rank: np.ndarray, buckets: int) -> DataFrame:
    """(token, s1) of prefix tokens that several sets of like size have. Tasks send packed numbers, a row per bucket: of a token that a task
    meets in several such sets one record for each size band goes to the token's bucket and all are sent on as known, spread over the buckets. So
    no bucket grows with the number of sets that have a token. A bucket keeps 32 bits of a token: a rare collision adds work, no result."""

    def emit(tokens: list[np.ndarray], sets: list[np.ndarray], turn: int) -> pa.RecordBatch:
        t, s, many = repeated(np.concatenate(tokens), np.concatenate(sets))
        first = np.ones(len(t), bool)
        first[1:] = (t[1:] != t[:-1]) | (s[1:] & BANDS != s[:-1] & BANDS)
        known_t, known_s = t[many], s[many]
        t, s = t[first], s[first]
        to = bucket_of(t, buckets)  # ascending, as t is
        rows = [(int(to[x[0]]), t[x].astype(np.uint32).tobytes(), s[x].tobytes(), b"", b"") for x in np.split(np.arange(len(t)), np.flatnonzero(np.diff(to)) + 1) if len(x)]
        rows += [((lo // KNOWN + turn) % buckets, b"", b"", known_t[lo : lo + KNOWN].tobytes(), known_s[lo : lo + KNOWN].tobytes()) for lo in range(0, len(known_t), KNOWN)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["bucket", "t", "s", "kt", "ks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sets, held, turn = [], [], 0, 0
        for batch in pieces(batches, "text"):
            all_tokens, offsets = shingle_sets(batch.column(0))
            s1, _ = set_ids(all_tokens, offsets)
            t, owner = prefixes(all_tokens, offsets, frequent, rank)
            tokens.append(t)
            sets.append(s1[owner])
            held += len(t)
            if held >= FLUSH:
                yield emit(tokens, sets, turn)
                tokens, sets, held, turn = [], [], 0, turn + 7
        if held:
            yield emit(tokens, sets, turn)

    def meet(rows: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in rows.column(c)])
        t, s, many = repeated(joined("t", np.uint32), joined("s", np.int64))
        high = np.uint64(rows.column("bucket")[0].as_py() << 32)
        # known tokens are named as their own bucket names them
        kt = joined("kt", np.uint64)
        named = (bucket_of(kt, buckets).astype(np.uint64) << np.uint64(32)) | (kt & np.uint64(0xFFFFFFFF))
        token = np.concatenate([high | t[many].astype(np.uint64), named]).view(np.int64)
        return pa.table({"token": pa.array(token), "s1": pa.array(np.concatenate([s[many], joined("ks", np.int64)]))})

    sent = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, t binary, s binary, kt binary, ks binary")
    return sent.groupBy("bucket").applyInArrow(meet, "token long, s1 long")


def least_shared() -> Column:
    """Prefix tokens of a set of n that any similar set shares at least: extra() of the smallest size that a similar set can have."""
    return 1 + F.floor(3 * F.floor((3 * F.col("n") + 3) / 4) / 20)


def active(sets: DataFrame) -> DataFrame:
    """Of s1, s2, n, comp, tokens, tile: tokens that sets of several components and several tiles hold (sets of one tile have been compared), and
    sets that have enough of them to be linked with another."""
    rows = sets.select("s1", "s2", F.explode("tokens").alias("token"))
    held = sets.select("comp", "tile", F.explode("tokens").alias("token")).groupBy("token")
    spread = held.agg(*[f(x).alias(f"{f.__name__}_{x}") for x in ("comp", "tile") for f in (F.min, F.max)]).where("min_comp <> max_comp and min_tile <> max_tile").select("token")
    left = rows.join(spread, "token", "left_semi").groupBy("s1", "s2").agg(F.collect_list("token").alias("tokens"))
    return left.join(sets.drop("tokens", "tile"), ["s1", "s2"]).where(F.size("tokens") >= least_shared()).select("s1", "s2", "n", "comp", "tokens")


def placed(sets: DataFrame, turn: int) -> DataFrame:
    """sets with the tile of each: in turns by the least of its tokens, in an order of this turn, and by the token that most sets have. What is
    too large for a tile is dealt to several."""
    if turn % 2 == 0:
        sets = sets.withColumn("least", F.array_min(F.transform("tokens", lambda t: F.xxhash64(F.lit(turn), t))))
    else:
        rows = sets.select("s1", "s2", F.explode("tokens").alias("token"))
        most = rows.join(rows.groupBy("token").count(), "token").groupBy("s1", "s2").agg(F.max(F.struct("count", "token"))["token"].alias("least"))
        sets = sets.join(most, ["s1", "s2"])
    weight = sets.groupBy("least").agg(F.sum("n").alias("weight"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    parts = F.ceil(F.col("weight") / TILE_TOKENS)
    part = F.xxhash64("least", F.pmod(F.xxhash64(F.lit(turn), "s1", "s2"), parts))
    tile = F.when(parts > 1, part).otherwise(F.pmod("least", F.lit(total // TILE_TOKENS + 1)))
    return sets.join(weight, "least").withColumn("tile", tile).drop("least", "weight")


def visits(sets: DataFrame, turn: int) -> DataFrame:
    """s1, s2, comp and tile of each set's own tile and of those that hold enough of its tokens in other components: the matrix over tiles,
    with a row for each token, tile and size band."""
    own = cut(placed(sets, turn), "tiles")
    band = F.col("s1").bitwiseAND(F.lit(BANDS)).alias("band")
    rows = own.select("s1", "s2", "n", "comp", "tile", band, F.explode("tokens").alias("token"))
    matrix = rows.groupBy("token", F.col("tile").alias("other"), F.col("band").alias("near")).agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
    met = rows.join(matrix, "token").where("tile <> other and abs(band - near) <= 1 and (comp <> a or comp <> b)")
    far = met.groupBy("s1", "s2", "n", "comp", "other").agg(F.count_distinct("token").alias("shared")).where(F.col("shared") >= least_shared())
    return own.select("s1", "s2", "comp", "tile").unionByName(far.select("s1", "s2", "comp", F.col("other").alias("tile")))


def link(sets: list[np.ndarray], label: np.ndarray | None = None) -> np.ndarray:
    """For sets of tokens (sorted, distinct): the number of the component of each. The token-group matrix search. label: components
    known so far, as numbers below the number of sets."""
    m = len(sets)
    label = np.arange(m) if label is None else label.copy()
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    names, ids = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    order = np.lexsort((sizes, np.array([s[0] for s in sets])))
    group = np.empty(m, np.int64)
    group[order] = np.arange(m) // GROUP
    n_groups = int(group.max()) + 1
    by = np.lexsort((ids, group[owner]))
    g_tokens, g_owner, g_group = ids[by], owner[by], group[owner][by]
    new = np.ones(len(by), bool)
    new[1:] = (g_tokens[1:] != g_tokens[:-1]) | (g_group[1:] != g_group[:-1])
    u_at = np.flatnonzero(new)  # a row for each (group, token)
    u_token, u_group = g_tokens[u_at], g_group[u_at]
    u_end = np.concatenate((u_at[1:], [len(by)]))
    u_begin = np.searchsorted(u_group, np.arange(n_groups + 1))
    matrix = np.argsort(u_token, kind="stable")  # rows of the matrix: groups of each token
    row = np.searchsorted(u_token[matrix], np.arange(len(names) + 1))
    members = [order[i * GROUP : (i + 1) * GROUP] for i in range(n_groups)]

    def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        n = hi - lo
        total = np.cumsum(n)
        return np.arange(total[-1]) + np.repeat(lo - np.concatenate(([0], total[:-1])), n)

    for q in order.tolist():
        mine = ids[begin[q] : begin[q + 1]]
        held = u_group[matrix[spans(row[mine], row[mine + 1])]]
        bound = np.bincount(held, minlength=n_groups)
        for g in np.flatnonzero(4 * bound >= 3 * sizes[q]).tolist():
            if g < group[q]:
                continue  # members of earlier groups have asked this one
            them = members[g]
            if (label[them] == label[q]).all():
                continue
            lo, hi = u_begin[g], u_begin[g + 1]
            at = np.searchsorted(u_token[lo:hi], mine) + lo
            at = at[(at < hi) & (u_token[np.minimum(at, hi - 1)] == mine)]
            shared = np.bincount(g_owner[spans(u_at[at], u_end[at])], minlength=m) if m <= 4096 else None
            if shared is None:
                hit, count = np.unique(g_owner[spans(u_at[at], u_end[at])], return_counts=True)
            else:
                hit, count = them, shared[them]
            for d in hit[7 * count >= 3 * (sizes[q] + sizes[hit])].tolist():
                if label[d] != label[q]:
                    a, b = sorted((int(label[d]), int(label[q])))
                    label[label == b] = a
    return label


def token_sets(docs: DataFrame, id_col: str, text: str, sets: DataFrame) -> DataFrame:
    """s1, s2, tokens of the sets, each from one document, whose key the sets have. Tasks know the documents by a sketch of the keys,
    so no text is moved; what the sketch lets through besides finds no set in the join that follows."""
    maps = docs.sparkSession.sparkContext.broadcast(sketch.of_keys(sets.select("key"), sets.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(0).to_numpy()
            hit = np.flatnonzero(sketch.repeated(maps.value, keys.view(np.uint64)))
            hit = [i for i, k in zip(hit.tolist(), keys[hit].tolist(), strict=True) if not (k in seen or seen.add(k))]
            for part in pieces(iter([batch.take(pa.array(hit, pa.int64()))]), "text"):
                tokens, offsets = shingle_sets(part.column(1))
                s1, s2 = set_ids(tokens, offsets)
                blobs = [tokens[lo:hi].tobytes() for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s1), pa.array(s2), pa.array(blobs, pa.binary())], names=["s1", "s2", "tokens"])

    return docs.select(F.xxhash64(F.lit(6), F.col(id_col), F.xxhash64(body(text))).alias("key"), F.col(text).alias("text")).mapInArrow(run, "s1 long, s2 long, tokens binary")


def search(rows: pa.Table) -> pa.Table:
    """Pairs of components that links between sets of a tile join."""
    s1, s2, comp = (rows.column(c).to_numpy() for c in ("s1", "s2", "comp"))
    order = np.lexsort((s2, s1))
    first = np.ones(len(order), bool)
    first[1:] = (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])
    own = order[first]  # a class that several equal rows stand for counts once
    names, label = np.unique(comp[own], return_inverse=True)
    blobs = rows.column("tokens")
    found = link([np.frombuffer(blobs[i].as_py(), np.uint64) for i in own.tolist()], label)
    moved = np.flatnonzero(found != label)
    return pa.table({"a": pa.array(names[label[moved]], pa.int64()), "b": pa.array(names[found[moved]], pa.int64())}).group_by(["a", "b"]).aggregate([])


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, row, n, s1, s2) per row of docs, and (s1, s2, rep, root, component_id) per class of equal sets."""
    measured = cut(measure(docs, id_col, text), "sets")
    rows = measured.where("n is not null").select("id", "row", "n", "s1", "s2")
    top = measured.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    values, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(values)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, counts))] = np.arange(len(values))
    total = rows.agg(F.sum("n")).first()[0] or 0
    key, node = F.min(F.xxhash64(F.lit(6), "id", "row")).alias("key"), F.xxhash64("s1", "s2")
    each = cut(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), key), "classes")
    shared = shared_tokens(docs, text, values[order], rank[order], max(1, total * 2 // 5 // BUCKET_TOKENS + 1))
    sets = shared.groupBy("s1").agg(F.collect_set("token").alias("tokens")).join(each, "s1").where(F.size("tokens") >= least_shared())
    held = cut(sets.select("s1", "s2", "n", node.alias("comp"), "tokens"), "candidates")
    members = cut(token_sets(docs, id_col, text, held.join(each.select("s1", "s2", "key"), ["s1", "s2"])), "members")
    links, sets = None, None
    for turn in range(ROUNDS + 1):
        if sets is not None:
            last, held = held, cut(active(sets), "active")
            drop(last)
        if not held.limit(1).count():
            break
        plan = placed(held, turn) if turn < ROUNDS else visits(held, turn)
        found = cut(plan.select("s1", "s2", "comp", "tile").join(members, ["s1", "s2"]).groupBy("tile").applyInArrow(search, "a long, b long"), "links")
        links = found if links is None else links.unionByName(found)
        if turn < ROUNDS:
            moved = connected(found)
            sets = plan.join(moved, plan["comp"] == moved["node"], "left").select("s1", "s2", "n", F.coalesce("root", "comp").alias("comp"), "tokens", "tile")
    if links is None:
        return rows, each.select("s1", "s2", "rep", node.alias("root"), F.col("rep").alias("component_id"))
    roots = connected(links)
    rooted = each.withColumn("node", node).join(roots, "node").select("s1", "s2", "root", "rep")
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component")), "root").select("s1", "s2", "root", "component")
    return rows, each.join(named, ["s1", "s2"], "left").select("s1", "s2", "rep", F.coalesce("root", node).alias("root"), F.coalesce("component", "rep").alias("component_id"))


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id of each row of docs."""
    rows, each = classes(docs, id_col, text)
    out = rows.join(each.drop("rep", "root"), ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the row of the smallest id that isn't null; of several such rows, the first by text. A
    row without words is a component of its own."""
    rows, each = classes(docs, id_col, text)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    of_class = rows.where("n > 0").groupBy("s1", "s2").agg(first)
    of_root = of_class.join(each.select("s1", "s2", "root"), ["s1", "s2"]).groupBy("root").agg(F.min("first").alias("first"))
    chosen = of_root.select(F.col("first.id").alias("id"), F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    stay, row, left = fresh(docs, "_id", "_row", "_stays")
    own = rows.where("n > 0").groupBy("id", "row").count()
    own = own.join(chosen.select(F.col("id").alias(stay), F.col("row").alias(row), "stays"), own["id"].eqNullSafe(F.col(stay)) & (own["row"] == F.col(row)), "left")
    # most rows stay and have no equals: only the others, and those without words never, are moved to be joined with what becomes of them
    doubt = cut(own.where("stays is null or count > 1").select(F.col("id").alias(stay), F.col("row").alias(row), F.coalesce("stays", F.lit(False)).alias(left)), "doubt")
    key = lambda i, r: F.xxhash64(F.lit(6), i, r)
    text_hash = F.xxhash64(body(docs[text]))
    may = sketch.among(doubt.select(key(F.col(stay), F.col(row))), key(docs[id_col], text_hash))
    met = docs.where(may).join(doubt, docs[id_col].eqNullSafe(doubt[stay]) & (F.xxhash64(body(docs[text])) == doubt[row]), "left")
    once = met.where(F.col(left)).dropDuplicates([stay, row])
    return docs.where(~may).unionByName(met.where(F.col(left).isNull()).select(*docs.columns)).unionByName(once.select(*docs.columns))
