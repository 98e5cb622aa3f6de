"""Row-wise visibility transforms, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.functions import coords, cplx
from fringelake.functions.cplx import Cx
from fringelake.model import VISIBILITY_KEY, required


def _uvw() -> tuple[Column, Column, Column]:
    return F.col("u"), F.col("v"), F.col("w")


def _with(df: DataFrame, vis: Cx | None = None, uvw=None) -> DataFrame:
    cols = {}
    if vis is not None:
        cols |= {"re": vis.re, "im": vis.im}
    if uvw is not None:
        cols |= dict(zip("uvw", uvw))
    return df.withColumns(cols)


# -- simulation and phase changes ------------------------------------------

def simulate_sky(df: DataFrame, sources: list[tuple[float, float, float]]) -> DataFrame:
    """Set (re, im) to the sum of point sources (l, m, flux).

    The source list is part of the expression: no join, no shuffle.
    """
    total = cplx.literal(0.0)
    for l, m, flux in sources:
        total = total.plus(coords.point_phasor(*_uvw(), l, m).scaled(F.lit(float(flux))))
    return _with(df, total)


def simulate_sky_table(df: DataFrame, key: list[str], sources: DataFrame,
                       block: int = 1024) -> DataFrame:
    """Same for a source table (source, l, m, flux) of any size.

    Sources are packed into blocks of at most ``block``, so that what is joined
    and shuffled grows with blocks. The sources of a block are unpacked next to
    the sum that consumes them.
    """
    packed = (sources.withColumn("block", F.floor(F.col("source") / block))
              .groupBy("block").agg(F.collect_list(F.struct("l", "m", "flux")).alias("sky")))
    top = sources.agg(F.floor(F.max("source") / block)).scalar()
    low = sources.agg(F.floor(F.min("source") / block)).scalar()
    rest = [c for c in df.columns if c not in (*key, "re", "im")]
    blocks = df.drop("re", "im").withColumn("block", F.explode(F.sequence(low, top)))
    each = blocks.join(packed, "block").select(*key, *rest, F.inline("sky"))
    z = coords.point_phasor(*_uvw(), F.col("l"), F.col("m")).scaled(F.col("flux"))
    return each.select(*key, *rest, z.re.alias("_re"), z.im.alias("_im")).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in rest], F.sum("_re").alias("re"), F.sum("_im").alias("im"))


def rotate(df: DataFrame, ra: float, dec: float, new_ra: float, new_dec: float) -> DataFrame:
    """Move visibilities to a new phase centre: rotate uvw, then multiply by the
    phasor of the new centre as seen from the old one."""
    xyz = coords.uvw_to_xyz(*_uvw(), -ra, dec)
    uvw = coords.xyz_to_uvw(*xyz, -new_ra, new_dec)
    moved = _with(df, uvw=uvw)
    l, m, _ = coords.radec_to_lmn(ra, dec, new_ra, new_dec)
    return _with(moved, cplx.col().times(coords.point_phasor(*_uvw(), l, m)))


def phase_rotate(df: DataFrame, ra: float, dec: float, new_ra: float, new_dec: float) -> DataFrame:
    """Channel-wise rotation of samples whose (u,v,w) are in metres. Directions
    within 1e-15 of the current centre leave the data alone."""
    l, m = coords.lmn_value((new_ra, new_dec), (ra, dec))
    if abs(l) <= 1e-15 and abs(m) <= 1e-15:
        return df
    lam = [coords.metres_to_wavelengths(c, F.col("freq")) for c in _uvw()]
    vis = cplx.col().times(coords.point_phasor(*lam, l, m).conj())
    xyz = coords.uvw_to_xyz(*_uvw(), -ra, dec)
    return _with(df, vis, coords.xyz_to_uvw(*xyz, -new_ra, new_dec))


def shift(df: DataFrame, dl: float, dm: float) -> DataFrame:
    return _with(df, cplx.col().times(coords.shift_phasor(F.col("u"), F.col("v"), dl, dm)))


def transform_uv(df: DataFrame, matrix) -> DataFrame:
    """Apply the inverse transpose of a 2x2 image transform to (u, v)."""
    (a, b), (c, d) = ((float(x) for x in row) for row in matrix)
    det = a * d - b * c
    u, v, w = _uvw()
    return _with(df, uvw=((u * d - v * b) / det, (v * a - u * c) / det, w))


def recentre(df: DataFrame, dl: float, dm: float) -> DataFrame:
    u, v, w = _uvw()
    return _with(df, uvw=(u - w * float(dl), v - w * float(dm), w))


def mirror(df: DataFrame, where: Column | None = None) -> DataFrame:
    """Replace samples with v < 0 (or ``where``) by their hermitian twin."""
    flip = F.col("v") < 0 if where is None else where
    flipped = df.withColumn("_flip", flip)
    sign = F.when(F.col("_flip"), -1.0).otherwise(1.0)
    return _with(flipped, Cx(F.col("re"), F.col("im") * sign),
                 [c * sign for c in _uvw()]).drop("_flip")


def mirror_swapping(df: DataFrame, where: Column) -> DataFrame:
    """Hermitian twin that also exchanges the two antennas."""
    marked = df.withColumn("_swap", where)
    out = mirror(marked, F.col("_swap"))
    return out.withColumns({
        "antenna1": F.when(F.col("_swap"), F.col("antenna2")).otherwise(F.col("antenna1")),
        "antenna2": F.when(F.col("_swap"), F.col("antenna1")).otherwise(F.col("antenna2")),
    }).drop("_swap")


def to_wavelengths(df: DataFrame) -> DataFrame:
    return _with(df, uvw=[coords.metres_to_wavelengths(c, F.col("freq")) for c in _uvw()])


def default_weight(df: DataFrame) -> DataFrame:
    """Missing weights count as one."""
    if "weight" not in df.columns:
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


# -- block form --------------------------------------------------------------

def explode_blocks(blocks: DataFrame) -> DataFrame:
    """Channel x polarisation blocks to one row per sample; block position is
    the channel and polarisation number."""
    per_chan = blocks.select(
        "antenna1", "antenna2", "time", "uvw.u", "uvw.v", "uvw.w",
        F.posexplode(F.arrays_zip("frequency", "vis", "weight")).alias("chan", "_c"))
    per_pol = per_chan.select(
        "antenna1", "antenna2", "time", "chan", F.col("_c.frequency").alias("freq"), "u", "v", "w",
        F.posexplode(F.arrays_zip(F.col("_c.vis").alias("vis"), F.col("_c.weight").alias("wt")))
        .alias("pol", "_p"))
    return per_pol.select("antenna1", "antenna2", "time", "chan", "freq", "pol", "u", "v", "w",
                          "_p.vis.re", "_p.vis.im", F.col("_p.wt").alias("weight"))


def pack_blocks(samples: DataFrame) -> DataFrame:
    """Inverse of :func:`explode_blocks`. A group is one (baseline, time), whose
    size is channels x polarisations."""
    key = ["antenna1", "antenna2", "time"]
    pols = samples.groupBy(*key, "chan").agg(
        *[F.first(c).alias(c) for c in ("freq", "u", "v", "w")],
        F.sort_array(F.collect_list(F.struct("pol", "re", "im", "weight"))).alias("_p"))
    chans = pols.groupBy(*key).agg(
        *[F.first(c).alias(c) for c in "uvw"],
        F.sort_array(F.collect_list(F.struct("chan", "freq", "_p"))).alias("_c"))
    return chans.select(
        *key, F.struct("u", "v", "w").alias("uvw"),
        F.transform("_c", lambda c: c["freq"]).alias("frequency"),
        F.transform("_c", lambda c: F.transform(
            c["_p"], lambda p: F.struct(p["re"].alias("re"), p["im"].alias("im")))).alias("vis"),
        F.transform("_c", lambda c: F.transform(c["_p"], lambda p: p["weight"])).alias("weight"))


# -- filters -----------------------------------------------------------------

def select_samples(df: DataFrame, **criteria) -> DataFrame:
    """Keep rows that meet every criterion: a value, a list of values, or a
    (low, high) tuple meaning low <= column <= high."""
    for name, want in criteria.items():
        c = F.col(name)
        if isinstance(want, tuple):
            df = df.where(c.between(*want))
        elif isinstance(want, (list, set)):
            df = df.where(c.isin(list(want)))
        else:
            df = df.where(c == want)
    return df


def baseline_length_between(df: DataFrame, low: float, high: float, order: str, tie: str) -> DataFrame:
    """Baselines whose uv length at their first sample lies in [low, high).

    The first sample is found by an aggregate with map-side combine, so a
    baseline with very many samples is no hot spot.
    """
    key = ["antenna1", "antenna2"]
    length = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    first = df.groupBy(*key).agg(
        F.min(F.struct(F.col(order), F.col(tie), length.alias("len"))).alias("_f"))
    keep = first.where((F.col("_f.len") >= low) & (F.col("_f.len") < high)).select(*key)
    return df.join(keep, key, "left_semi")


def wanted_baselines(df: DataFrame, wanted: DataFrame) -> DataFrame:
    return df.join(wanted, ["antenna1", "antenna2"], "left_semi")


def unseen_frequencies(new: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``new`` whose (baseline, frequency) is not stored yet."""
    key = ["antenna1", "antenna2", "freq"]
    return new.join(present.select(*key).distinct(), key, "left_anti")


# -- combination -------------------------------------------------------------

def weighted_mean(re: str = "re", im: str = "im", weight: str = "weight") -> list[Column]:
    """Aggregates for the weighted mean of visibilities: the mean is zero and
    the weight zero where no weight is left; weights add in quadrature."""
    w = F.col(weight)
    norm = F.sqrt(F.sum(w * w))
    mean = [F.when(norm > 0, F.try_divide(F.sum(F.col(c) * w), F.sum(w))).otherwise(0.0).alias(c)
            for c in (re, im)]
    return [*mean, norm.alias(weight)]


def combine(left: DataFrame, right: DataFrame, w1: float = 1.0, w2: float = 1.0,
            key: list[str] | None = None) -> DataFrame:
    """Weighted combination of two sets with the same samples. A sample that one
    set lacks, or whose frequencies differ by 1 Hz or more, raises an error.

    Both sets are stacked and summed by sample, so rows combine before the one
    shuffle; a join would shuffle both sides whole.
    """
    key = key or VISIBILITY_KEY
    rest = [c for c in left.columns if c not in (*key, "re", "im", "weight")]
    both = (left.withColumns({"weight": F.col("weight") * w1, "_left": F.lit(True)})
            .unionByName(right.withColumns({"weight": F.col("weight") * w2, "_left": F.lit(False)})))
    spread = F.max("freq") - F.min("freq") if "freq" in left.columns else F.lit(0.0)
    out = both.groupBy(*key).agg(
        *[F.first(F.when(F.col("_left"), F.col(c)), ignorenulls=True).alias(c) for c in rest],
        *weighted_mean(), (F.bool_or("_left") & F.bool_or(~F.col("_left"))).alias("_both"),
        spread.alias("_spread"))
    return out.withColumn("weight", F.when(~F.col("_both"), F.raise_error(F.lit(
        "a sample of one set is missing in the other"))).when(F.col("_spread") >= 1.0, F.raise_error(
            F.lit("the sets differ in frequency"))).otherwise(F.col("weight"))).drop("_both", "_spread")


def concatenate(left: DataFrame, right: DataFrame, right_centre=None, centre=None) -> DataFrame:
    """Rows of both sets; the second is rotated to the first's phase centre."""
    if right_centre and centre and right_centre != centre:
        right = phase_rotate(right, *right_centre, *centre)
    return left.unionByName(right)


def concatenate_frequencies(left: DataFrame, right: DataFrame, right_centre=None,
                            centre=None) -> DataFrame:
    """Channels of the second set appended after those of the first, joined per
    (baseline, time) in block form. A row that only one set has raises an error."""
    if right_centre and centre and right_centre != centre:
        right = pack_blocks(phase_rotate(explode_blocks(right), *right_centre, *centre))
    key = ["antenna1", "antenna2", "time"]
    other = right.select(*key, *[F.col(c).alias(f"_{c}") for c in ("frequency", "vis", "weight")])
    return left.join(other, key, "full").select(*key, "uvw", *[
        required(F.concat(c, f"_{c}"), "a row of one set is missing in the other").alias(c)
        for c in ("frequency", "vis", "weight")])


def shared_frequencies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Frequencies present in both sets; empty when they may be concatenated."""
    return left.select("freq").intersect(right.select("freq"))


def merge_last_wins(base: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """Union of two tables where a row of ``update`` replaces the row with the
    same key. One aggregate keeps the row of the later source."""
    rest = [c for c in base.columns if c not in key]
    both = base.withColumn("_src", F.lit(0)).unionByName(update.withColumn("_src", F.lit(1)))
    return (both.groupBy(*key).agg(F.max(F.struct("_src", *rest)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def merge_disjoint(parts: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Assemble pieces of a table that must not overlap: zero rows are padding,
    two non-zero rows for one key are an error."""
    filled = F.lit(False)
    for c in values:
        filled = filled | (F.col(c) != 0)
    out = parts.groupBy(*key).agg(F.count_if(filled).alias("_n"),
                                  *[F.sum(c).alias(c) for c in values])
    ok = F.when(F.col("_n") <= 1, F.col(values[0])).otherwise(
        F.raise_error(F.lit("pieces overlap")))
    return out.withColumn(values[0], ok).drop("_n")


def coverage(df: DataFrame) -> DataFrame:
    """(u,v,w) of every sample and of its mirror image, in one pass."""
    both = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("_s")
    return df.select("u", "v", "w", both).select(
        *[(F.col(c) * F.col("_s")).alias(c) for c in "uvw"])


def stokes_i(xx: Cx, yy: Cx) -> Cx:
    return xx.plus(yy).scaled(F.lit(0.5))
