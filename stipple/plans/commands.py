"""Whole workflows, one function each, composed of the operators: tables in, tables out.

Readers and writers stay outside (``stipple.sources``), so every workflow also runs on Parquet tables. A result of
several tables is a dict of lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stipple.functions import seq
from stipple.operators import aggregates, diffexp, filters, joins, ordering, project, raster, sets, spatial
from stipple.sources import matrices


# --- barcodes --------------------------------------------------------------------------------------------------------
def build_barcodes(reads: DataFrame, form: seq.BarcodeFormat, *, names: str = "illumina", force_lane: int = 0) -> dict[str, DataFrame]:
    """Spatial barcodes of reads (name, seq): seq, lane, tile, x, y, mismatches; and the manifest per tile.

    A read name that can't be read is an error.
    """
    place = seq.illumina_name(F.col("name")) if names == "illumina" else seq.grid_name(F.col("name"))
    own = reads.withColumn("_p", place)
    lane = F.lit(force_lane) if force_lane else F.when(F.col("_p").isNull(), F.raise_error(F.concat(F.lit("unreadable name: "), "name")).cast("int")).otherwise(F.col("_p.lane"))
    part = F.substring("seq", 1, form.length)
    rows = own.select(
        (seq.revcomp(part) if form.revcomp else part).alias("seq"), lane.alias("lane"), F.col("_p.tile").alias("tile"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"),
        seq.best_mismatches(part, form.patterns).alias("mismatches"),
    )
    manifest = aggregates.tile_stats(rows, ["lane", "tile"], x="x", y="y").withColumn("id", F.concat_ws("_", F.col("lane").cast("string"), F.col("tile").cast("string")))
    return {"barcodes": rows, "manifest": manifest}


def combine_barcodes(barcodes: DataFrame, layout: DataFrame, *, nm: float = 34.78, match_len: int = 27, max_dup: int = 1, max_dist: float = 1000.0, row_gap: float = 0.0, col_gap: float = 0.0) -> dict[str, DataFrame]:
    """Tiles on one plane in nanometres; duplicated barcodes are kept if few and close together.

    barcodes: strid, lane, tile, px, py, mismatches; layout: lane, tile, row, col[, rowshift, colshift].
    """
    tiles = barcodes.groupBy("lane", "tile").agg(F.min("px").alias("xmin"), F.max("px").alias("xmax"), F.min("py").alias("ymin"), F.max("py").alias("ymax"))
    placed = project.layout_offsets(joins.manifest_layout(tiles, layout, on=["lane", "tile"]).select(*layout.columns), tiles, row_gap=row_gap, col_gap=col_gap)
    own = barcodes.join(placed.select("lane", "tile", "x_offset", "y_offset"), ["lane", "tile"]).join(tiles, ["lane", "tile"])
    own = project.global_nm(own, nm=nm).select("strid", "px", "py", "mismatches")
    spread = aggregates.duplicate_spread(own, F.substring("strid", 1, match_len), order=["strid", "px", "py"], max_dup=max_dup)
    kept = spread.filter((F.col("n") <= max_dup) & (F.col("max_dist") <= max_dist)).select("first.*").withColumns({"lane": F.lit(1), "tile": F.lit(1)})
    return {"barcodes": kept, "duplicates": spread.select("key", F.col("n").alias("ndups"), F.col("max_dist").alias("max_dist_nm"))}


def evaluate_duplicates(barcodes: DataFrame, *, match_len: int = 27) -> dict[str, DataFrame]:
    """Barcodes by multiplicity and tiles, the histogram, and the tiles' shares."""
    key, tile = F.substring("strid", 1, match_len), F.concat_ws("_", F.col("lane").cast("string"), F.col("tile").cast("string"))
    return {"keys": aggregates.duplicates(barcodes, key, tile), "histogram": aggregates.duplicate_multiplicity(barcodes, key, tile), "tiles": aggregates.duplicates_by_tile(barcodes, key, tile)}


def match_barcodes(reads: DataFrame, dictionary: DataFrame, *, skip: int = 0, length: int = 27, unique: bool = False) -> dict[str, DataFrame]:
    """Reads' barcodes found in a dictionary, once each with its multiplicity, and the summary."""
    own = reads.select(F.substring("seq", skip + 1, length).alias("seq"))
    if unique:
        found = joins.match_unique(own, dictionary, read="seq", length=length)
        matched = own.join(found.select(F.col("key").alias("seq")), "seq", "left_semi")
        table = found.withColumnRenamed("key", "seq")
    else:
        matched = joins.match_barcodes(own, dictionary, read="seq", length=length)
        rest = [c for c in matched.columns if c != "seq"]
        table = matched.groupBy("seq").agg(F.min(F.struct(*rest)).alias("_v"), F.count(F.lit(1)).alias("ndups")).select("seq", "_v.*", "ndups")
    return {"matched": table, "summary": aggregates.match_summary(own, matched.select("seq"), key="seq")}


def merge_tags(batches: Sequence[DataFrame], tags: DataFrame) -> dict[str, DataFrame]:
    """Matched tags (barcode, tag, umi) of all batches as a matrix of reads, distinct UMIs and presence."""
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    counts = aggregates.tag_counts(every)
    bcd = ordering.dense_ids(counts.select("barcode").distinct(), ["barcode"], name="bcd")
    ftr = ordering.dense_ids(tags.select("tag_id", "tag_name"), ["tag_id"], name="ftr")
    entries = counts.join(bcd, "barcode").join(ftr.select(F.col("tag_id").alias("tag"), "ftr"), "tag").select("ftr", "bcd", F.col("reads").alias("c1"), F.col("umis").alias("c2"), F.col("present").alias("c3"))
    return {"entries": entries, "barcodes": bcd, "features": ftr.withColumn("type", F.lit("Antibody_Tag"))}


# --- reads -----------------------------------------------------------------------------------------------------------
def common_barcodes(pairs: DataFrame, *, bcd: str = "1-27", umi: str = "31-39", bcd_read: str = "seq1", umi_read: str = "seq1", least: int = 2, most: int | None = None) -> DataFrame:
    """Read pairs whose (barcode, UMI) occurs from ``least`` to ``most`` times, with barcode, umi and n."""
    own = pairs.withColumns({"barcode": seq.intervals(F.col(bcd_read), bcd), "umi": seq.intervals(F.col(umi_read), umi)})
    return filters.frequency(own, ["barcode", "umi"], least, most, count="n")


def reformat_pairs(pairs: DataFrame, *, whitelist: DataFrame | None = None, match_len: int = 27, skip: int = 0, **layout) -> DataFrame:
    """Pairs with a barcode of the whitelist in the new layout."""
    own = filters.prefix_whitelist(pairs, "seq1", whitelist, "barcode", skip=skip, length=match_len) if whitelist is not None else pairs
    return project.relay_fastq(own, skip=skip, **layout)


# --- matrices --------------------------------------------------------------------------------------------------------
def spatial_counts(parts: Sequence[DataFrame], barcodes: DataFrame, places: DataFrame, *, length: int = 27) -> dict[str, DataFrame]:
    """Matrices (ftr, bcd, cnt) of several kinds side by side with the barcodes' first place, and their counts at three levels.

    A barcode without a place is at lane 0, tile 0.
    """
    merged = joins.merge_matrices(parts)
    counts = [c for c in merged.columns if c not in ("bcd", "ftr")]
    placed = joins.first_match(barcodes, places, F.substring("strid", 1, length), F.substring("strid", 1, length), [F.col("lane"), F.col("tile")], ["lane", "tile", "px", "py"], default=0)
    own = merged.join(placed.select(F.col("nid").alias("bcd"), "lane", "tile"), "bcd")
    levels = aggregates.levels(own, "lane", "tile", {c: F.sum(c) for c in counts} | {"lines": F.count(F.lit(1)), "barcodes": F.count_distinct("bcd")})
    return {"entries": merged, "barcodes": placed.join(aggregates.count_vectors(merged, "bcd", counts).withColumnRenamed("bcd", "nid"), "nid"), "levels": levels}


def molecules_of(entries: DataFrame, barcodes: DataFrame, features: DataFrame, counts: Sequence[str], *, units_per_um: float = 1.0, keep_zero: bool = False, **match) -> dict[str, DataFrame]:
    """A matrix with coordinates as molecule rows X, Y, gene, gene_id and counts; feature totals and the extent of all barcodes."""
    chosen = filters.features(features, "name", **match) if match else features
    own = entries if keep_zero else filters.positive(entries, counts)
    rows = joins.matrix_entries(own, barcodes, chosen, strict=not match).select((F.col("x") / units_per_um).alias("X"), (F.col("y") / units_per_um).alias("Y"), F.col("ftr_name").alias("gene"), F.col("ftr_id").alias("gene_id"), *counts)
    totals = rows.groupBy("gene", "gene_id").agg(*(F.sum(c).alias(c) for c in counts))
    return {"molecules": rows, "features": totals, "extent": aggregates.extent(project.to_units(barcodes, ["x", "y"], units_per_um))}


def subset_grid(entries: DataFrame, barcodes: DataFrame, features: DataFrame, counts: Sequence[str], *, box: tuple[float, float, float, float], rings: Sequence | None = None, whitelist: DataFrame | None = None) -> dict[str, DataFrame]:
    """Barcodes in a box (xmin, xmax, ymin, ymax) and rings or on a list, moved to the box's origin, with renumbered entries."""
    own = filters.in_box(barcodes, "px", "py", *box)
    own = filters.in_polygons(own, "px", "py", rings) if rings else own
    own = filters.in_list(own, "strid", whitelist, "value") if whitelist is not None else own
    own = own.withColumns({"px": F.greatest(F.col("px") - F.lit(box[0]), F.lit(0.0)), "py": F.greatest(F.col("py") - F.lit(box[2]), F.lit(0.0))})
    e, b, f = matrices.compact(entries, own, features, counts)
    return {"entries": e, "barcodes": b, "features": f, "extent": aggregates.extent(b, "px", "py")}


def subset_matrix(entries: DataFrame, barcodes: DataFrame, features: DataFrame, counts: Sequence[str], *, min_feature: int = 0, min_barcode: int = 0, include: DataFrame | None = None, exclude: DataFrame | None = None) -> dict[str, DataFrame]:
    """Features by list (id or name) and total, then barcodes by their total over what is left, renumbered."""
    chosen = features
    if include is not None:
        chosen = chosen.join(include.select(F.col("value").alias("_v")), (F.col("id") == F.col("_v")) | (F.col("name") == F.col("_v")), "left_semi")
    if exclude is not None:
        chosen = chosen.join(exclude.select(F.col("value").alias("_v")), (F.col("id") == F.col("_v")) | (F.col("name") == F.col("_v")), "left_anti")
    own = entries.join(chosen.select(F.col("nid").alias("ftr")), "ftr", "left_semi")
    own = filters.min_totals(own, "ftr", counts[0], min_feature) if min_feature else own
    own = filters.min_totals(own, "bcd", counts[0], min_barcode) if min_barcode else own
    e, b, f = matrices.compact(own, barcodes, chosen, counts)
    return {"entries": e, "barcodes": b, "features": f}


def to_sparse(long: DataFrame, unit: Sequence[str], *, min_feature: int = 1, min_unit: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """Sparse rows of counts (unit columns, feature, cnt), features by total, then units by their total over them; with the dictionary."""
    own = filters.min_totals(long, "feature", "cnt", min_feature) if min_feature > 1 else long
    own = filters.min_totals(own, unit[0], "cnt", min_unit) if min_unit else own
    names = ordering.dense_ids(own.select("feature").distinct(), ["feature"], name="idx").withColumn("idx", F.col("idx") - 1)
    return {"rows": matrices.sparse_rows(own, names, unit, seed=seed), "dictionary": names, "features": aggregates.feature_totals(long, name="feature", count="cnt", key="feature")}


def cells_to_sparse(molecules: DataFrame, *, cell: str = "cell_id", gene: str = "gene", count: str = "count", x: str = "X", y: str = "Y", min_feature: int = 1, min_cell: int = 1, ignore: Sequence[str] = filters.NULL_IDS) -> dict[str, DataFrame]:
    """Molecules with a cell as sparse rows, and the cells' centroids over all their molecules."""
    own = filters.known_ids(molecules, cell, ignore)
    long = aggregates.cell_by_feature(own, cell, gene, count).withColumnsRenamed({cell: "cell_id", gene: "feature"})
    out = to_sparse(long, ["cell_id"], min_feature=min_feature, min_unit=min_cell)
    centre = aggregates.weighted_centroid(own.withColumnRenamed(cell, "cell_id"), "cell_id", x, y, count)
    meta = out["rows"].select("cell_id", F.col("n_genes").alias("genes"), F.col("n_mols").alias("counts")).join(centre.select("cell_id", "cx", "cy"), "cell_id")
    return out | {"cells": meta}


def merge_sparse(samples: Sequence[tuple[str, DataFrame]], *, least: int = 0, seed: int = 0) -> dict[str, DataFrame]:
    """Samples of long counts (cell_id, feature, cnt) as one sparse table; with ``least`` only features that reach it in every sample."""
    both = sets.union_samples(samples)
    if least:
        kept = filters.in_every_sample(both, "feature", "sample_id", "cnt", least)
        both = both.join(kept, "feature", "left_semi")
    order = F.create_map(*(v for i, (n, _) in enumerate(samples) for v in (F.lit(n), F.lit(i))))
    names = sets.merged_dictionary(both.withColumn("sample_no", order[F.col("sample_id")]))
    return {"rows": matrices.sparse_rows(both, names, ["sample_id", "cell_id"], seed=seed), "dictionary": names, "features": aggregates.feature_totals(both, name="feature", count="cnt", key="feature")}


def sparse_to_matrix(rows: DataFrame, dictionary: DataFrame, unit: Sequence[str], *, delim: str = ":") -> dict[str, DataFrame]:
    """Sparse rows as entries with 1-based ids; a barcode is the unit's columns joined."""
    long = project.compose_id(matrices.sparse_to_long(rows, dictionary, unit), unit, name="strid", delim=delim)
    b = ordering.dense_ids(long.select("strid").distinct(), ["strid"], name="nid")
    f = ordering.dense_ids(dictionary, ["idx"], name="nid").select(F.col("feature").alias("id"), F.col("feature").alias("name"), "nid")
    e = long.join(b.select("strid", F.col("nid").alias("bcd")), "strid").join(f.select(F.col("id").alias("feature"), F.col("nid").alias("ftr")), "feature")
    return {"entries": e.select("ftr", "bcd", F.col("cnt").alias("c1")), "barcodes": b, "features": f}


# --- factors ---------------------------------------------------------------------------------------------------------
def top_factor(topics: DataFrame, factors: Sequence[str], *, reorder: bool = False, keep_random_key: bool = False) -> DataFrame:
    """Topic rows with their largest factor; with ``reorder`` factors go by falling total."""
    own = project.drop_random_key(topics, keep=keep_random_key)
    own = project.order_by_total(own, factors) if reorder else own
    return ordering.argmax_columns(own, [c for c in own.columns if c in factors])


def decode_expression(rows: DataFrame, pairs: Sequence[tuple[str, str | None]], *, feature: str = "feature", count: str = "ct", max_pval: float = 1e-3, min_fc: float = 1.5, pseudocount: float = 0.5) -> dict[str, DataFrame]:
    """Pseudobulk of decoded molecules and its differential expression."""
    long = aggregates.pseudobulk(rows, feature, F.col(count), [(F.col(k), F.col(p) if p else None) for k, p in pairs])
    tested = diffexp.marginal(long, pseudocount=pseudocount)
    return {"posterior": long, "expression": diffexp.report(tested, max_pval=max_pval, min_fc=min_fc, min_count=0.0, fallback=False)}


def join_pixels(molecules: DataFrame, sources: Sequence[tuple[str, DataFrame]], max_distance: float, *, mol_id: str = "mol_id", x: str = "x", y: str = "y", max_k: int = 1, missing: str | None = "NA") -> dict[str, DataFrame]:
    """Molecules with the factors of the nearest pixel of every source (pix_id, x, y, k, p), and the histogram of squared distances."""
    out, hist = molecules, None
    for prefix, pix in sources:
        near = spatial.nearest(molecules.select(mol_id, x, y), pix, max_distance, point_id=mol_id, target_id="pix_id", x=x, y=y, values=["k", "p"])
        h = aggregates.decile_histogram(near, F.col("d2")).withColumn("prefix", F.lit(prefix))
        hist = h if hist is None else hist.unionByName(h)
        pick = lambda c, i: F.get(c, F.lit(i)).cast("string") if missing is None else F.coalesce(F.get(c, F.lit(i)).cast("string"), F.lit(missing))
        side = near.select(mol_id, *(pick(c, i).alias(f"{prefix}{c.upper()}{i + 1}") for c in ("k", "p") for i in range(max_k)))
        out = out.join(side, mol_id)
    return {"molecules": out, "histogram": hist}


def split_by_bin(molecules: DataFrame, bins: DataFrame, *, feature: str = "gene", count: str = "count") -> dict[str, DataFrame]:
    """Molecules with their feature's bin (null where it has none; 0 is unassigned), and the index of bins, by observed rows."""
    own = joins.lookup(molecules, bins.select(F.col(feature), "bin"), feature)
    index = own.filter("bin > 0").groupBy(F.col("bin").alias("bin_id")).agg(F.sum(count).alias("molecule_count"), F.count_distinct(feature).alias("features_count"))
    return {"molecules": own, "index": index}


def cluster_model(long: DataFrame, clusters: DataFrame, *, min_count: float = 0) -> DataFrame:
    """feature, cluster, cnt of hard clusters (cell_id, cluster) or probabilities (cell_id, cluster, prob)."""
    return aggregates.model_matrix(long, clusters, min_count=min_count)


# --- pictures --------------------------------------------------------------------------------------------------------
def draw_points(points: DataFrame, width: int, height: int, *, x: str = "x", y: str = "y", per_pixel: float = 1.0, count: str | None = None, auto_adjust: bool = False, quantile: float = 0.99, invert: bool = False):
    """A gray picture of points as an array."""
    image = raster.intensity(points, x, y, per_pixel, count=count)
    image = raster.stretch(image, quantile) if auto_adjust else image
    image = raster.invert(image) if invert else image
    return raster.to_image(image, width, height, ["value"])[..., 0]


def draw_colors(points: DataFrame, color: Column, width: int, height: int, *, x: str = "x", y: str = "y", per_pixel: float = 1.0, count: Column | None = None):
    """A picture of points in their colors as an array."""
    return raster.to_image(raster.colored_points(points, x, y, per_pixel, color, count=count), width, height)
