"""Name groups by ordered rules, hit spectra per group, unmatched names, name extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that are groups of their own (fixed values).
LITERAL_GROUPS = (
    "foot", "tank", "skirt", "water", "innercryostat", "outercryostat", "atmosphericlar", "undergroundlar", "reentrancetube", "neutronmoderator", "vacuumgap", "noVolume",
)


#: Groups and patterns of names, in order; the first that fits counts (fixed values).
RULES = (
    ("V_detector", r"^V\d{4}$"),
    ("S_module_bottom", r"^S\d{4}B$"),
    ("S_module_top", r"^S\d{4}T$"),
    ("PMT_main", r"^PMT\d{6}$"),
    ("PMT_3inch", r"^PMT300\d{4}$"),
    ("V_penetration", r"^V\d{4}_pen$"),
    ("S_wrap_bottom", r"^S\d{4}B_wrap$"),
    ("S_wrap_top", r"^S\d{4}T_wrap$"),
    ("fiber_sipm", r"^fiber_S\d{4}_s$"),
    ("fiber_core", r"^fiber_core_l[\d.]+$"),
    ("fiber_cl1", r"^fiber_cl1_l[\d.]+$"),
    ("fiber_cl2_tpb", r"^fiber_cl2_l[\d.]+_tpb\d+$"),
    ("PMT_vacuum", r"^PMT\d{6}_vacuum$"),
    ("PMT_window", r"^PMT\d{6}_window$"),
    ("PMT_3inch_vacuum", r"^PMT300\d{4}_vacuum$"),
    ("PMT_3inch_window", r"^PMT300\d{4}_window$"),
    ("V_click_top_0", r"^V\d{4}_click_top_0$"),
    ("V_click_top_1", r"^V\d{4}_click_top_1$"),
    ("V_click_top_2", r"^V\d{4}_click_top_2$"),
    ("V_hv_cable_string_1", r"^V\d{4}_hv_cable_string_1$"),
    ("V_hv_cable_string_2", r"^V\d{4}_hv_cable_string_2$"),
    ("V_hv_cable_string_3", r"^V\d{4}_hv_cable_string_3$"),
    ("V_hv_cable_string_4", r"^V\d{4}_hv_cable_string_4$"),
    ("V_hv_cable_string_5", r"^V\d{4}_hv_cable_string_5$"),
    ("V_hv_cable_string_6", r"^V\d{4}_hv_cable_string_6$"),
    ("V_hv_cable_string_7", r"^V\d{4}_hv_cable_string_7$"),
    ("V_hv_cable_string_8", r"^V\d{4}_hv_cable_string_8$"),
    ("V_hv_cable_string_9", r"^V\d{4}_hv_cable_string_9$"),
    ("V_hv_clamp_string_1", r"^V\d{4}_hv_clamp_string_1$"),
    ("V_hv_clamp_string_2", r"^V\d{4}_hv_clamp_string_2$"),
    ("V_hv_clamp_string_3", r"^V\d{4}_hv_clamp_string_3$"),
    ("V_hv_clamp_string_4", r"^V\d{4}_hv_clamp_string_4$"),
    ("V_hv_clamp_string_5", r"^V\d{4}_hv_clamp_string_5$"),
    ("V_hv_clamp_string_6", r"^V\d{4}_hv_clamp_string_6$"),
    ("V_hv_clamp_string_7", r"^V\d{4}_hv_clamp_string_7$"),
    ("V_hv_clamp_string_8", r"^V\d{4}_hv_clamp_string_8$"),
    ("V_hv_clamp_string_9", r"^V\d{4}_hv_clamp_string_9$"),
    ("V_signal_asic_string_1", r"^V\d{4}_signal_asic_string_1$"),
    ("V_signal_asic_string_2", r"^V\d{4}_signal_asic_string_2$"),
    ("V_signal_asic_string_3", r"^V\d{4}_signal_asic_string_3$"),
    ("V_signal_asic_string_4", r"^V\d{4}_signal_asic_string_4$"),
    ("V_signal_asic_string_5", r"^V\d{4}_signal_asic_string_5$"),
    ("V_signal_asic_string_6", r"^V\d{4}_signal_asic_string_6$"),
    ("V_signal_asic_string_7", r"^V\d{4}_signal_asic_string_7$"),
    ("V_signal_asic_string_8", r"^V\d{4}_signal_asic_string_8$"),
    ("V_signal_asic_string_9", r"^V\d{4}_signal_asic_string_9$"),
    ("V_signal_cable_string_1", r"^V\d{4}_signal_cable_string_1$"),
    ("V_signal_cable_string_2", r"^V\d{4}_signal_cable_string_2$"),
    ("V_signal_cable_string_3", r"^V\d{4}_signal_cable_string_3$"),
    ("V_signal_cable_string_4", r"^V\d{4}_signal_cable_string_4$"),
    ("V_signal_cable_string_5", r"^V\d{4}_signal_cable_string_5$"),
    ("V_signal_cable_string_6", r"^V\d{4}_signal_cable_string_6$"),
    ("V_signal_cable_string_7", r"^V\d{4}_signal_cable_string_7$"),
    ("V_signal_cable_string_8", r"^V\d{4}_signal_cable_string_8$"),
    ("V_signal_cable_string_9", r"^V\d{4}_signal_cable_string_9$"),
    ("V_signal_clamp_string_1", r"^V\d{4}_signal_clamp_string_1$"),
    ("V_signal_clamp_string_2", r"^V\d{4}_signal_clamp_string_2$"),
    ("V_signal_clamp_string_3", r"^V\d{4}_signal_clamp_string_3$"),
    ("V_signal_clamp_string_4", r"^V\d{4}_signal_clamp_string_4$"),
    ("V_signal_clamp_string_5", r"^V\d{4}_signal_clamp_string_5$"),
    ("V_signal_clamp_string_6", r"^V\d{4}_signal_clamp_string_6$"),
    ("V_signal_clamp_string_7", r"^V\d{4}_signal_clamp_string_7$"),
    ("V_signal_clamp_string_8", r"^V\d{4}_signal_clamp_string_8$"),
    ("V_signal_clamp_string_9", r"^V\d{4}_signal_clamp_string_9$"),
    ("V_insulator_0", r"^V\d{4}_insulator_du_holder_0$"),
    ("V_insulator_1", r"^V\d{4}_insulator_du_holder_1$"),
    ("V_insulator_2", r"^V\d{4}_insulator_du_holder_2$"),
    ("tyvek_bot", r"^my_tyvek_bot_foil$"),
    ("tyvek_pit", r"^my_tyvek_pit_foil$"),
    ("tyvek_top", r"^my_tyvek_top_foil$"),
    ("tyvek_zyl", r"^my_tyvek_zyl_foil$"),
    ("tyvek_bottom", r"^tyvek_bottom_foil$"),
    ("tyvek_prism", r"^tyvek_prism_foil$"),
    ("cu_rod_0", r"^string_\d+_cu_rod_0$"),
    ("cu_rod_1", r"^string_\d+_cu_rod_1$"),
    ("cu_rod_2", r"^string_\d+_cu_rod_2$"),
    ("tristar_xlarge", r"^tristar_xlarge_string_\d+$"),
    ("string_support", r"^string_support_structure_string_\d+$"),
)


def rules() -> list[tuple[str, str]]:
    """(group, pattern) in order."""
    return list(RULES)


def assign_group(name: Column) -> Column:
    """The name itself if it is a group, else the first rule that fits, else `unmatched`."""
    case = F.when(name.isin(*LITERAL_GROUPS), name)
    for group, pattern in rules():
        case = case.when(name.rlike(pattern), F.lit(group))
    return case.otherwise(F.lit("unmatched"))


def grouped_names(names: DataFrame, column: str = "name") -> DataFrame:
    """Each distinct name once with its group: rules run on the dictionary, never on events."""
    return names.select(F.col(column).alias("name")).distinct().withColumn("group_name", assign_group(F.col("name")))


def unmatched_names(grouped: DataFrame) -> DataFrame:
    return grouped.where("group_name = 'unmatched'").select("name")


def event_totals(events: DataFrame, hits: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Total hits and number of voxels hit for every event, 0 without any."""
    sums = hits.where("hits > 0").groupBy(*keys).agg(F.sum("hits").alias("total_hits"), F.count("*").alias("voxels_hit"))
    return events.join(sums, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_hits", "voxels_hit")})


def spectrum_stats(totals: DataFrame, grouped: DataFrame, name: str = "name") -> DataFrame:
    """Per group: events, mean and median of hits and of voxels hit. Names without a group count as unmatched."""
    joined = totals.join(grouped.select(F.col("name").alias(name), "group_name"), name, "left").withColumn("group_name", F.coalesce("group_name", F.lit("unmatched")))
    return joined.groupBy("group_name").agg(F.count("*").alias("n_events"), F.avg("total_hits").alias("mean_hits"), F.avg("voxels_hit").alias("mean_voxels"), F.median("total_hits").alias("median_hits"), F.median("voxels_hit").alias("median_voxels"))


def extract_names(lines: DataFrame, pattern: str = r'^\s*<physvol\s+name="([^"]+)"', column: str = "value") -> DataFrame:
    """Distinct captures of a pattern, one line at a time, every match of it (column name); order by (length, name) with `ordered`."""
    return lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("name")).where("name <> ''").distinct()


def ordered(names: DataFrame) -> DataFrame:
    return names.orderBy(F.length("name"), "name")


def write_report(names: DataFrame, path: str, title: str = "unmatched names") -> None:
    """A text file of a count line and the sorted names. One file: the names come from a dictionary."""
    count = names.agg(F.concat(F.lit(f"{title}: "), F.count("*").cast("string")).alias("value"), F.lit(0).alias("o"))
    rows = count.unionByName(names.select(F.col("name").alias("value"), F.lit(1).alias("o")))
    rows.coalesce(1).sortWithinPartitions("o", "value").select("value").write.mode("overwrite").text(path)
