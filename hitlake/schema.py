"""Schemas, geometry preset and column orders of the data model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Detectors whose hits are kept (fixed values).
DETECTORS = (1965, 1966, 1967, 1968)
LAYERS = ("pit", "bot", "wall", "top")
KEY = ("file_idx", "evtid", "nc_id")


@dataclass(frozen=True)
class Geometry:
    """Cylinder in mm: radius, height between the cuts, lower cut; `lift` is taken off the height for the upper cut."""

    radius: float = 4300.0
    height: float = 8900.0
    cut_bottom: float = -4979.0
    lift: float = 2.0

    @property
    def cut_top(self) -> float:
        return self.cut_bottom + self.height - self.lift


RAW_NC = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("row_ix", T.LongType()),
        T.StructField("evtid", T.LongType()),
        T.StructField("nC_track_id", T.LongType()),
        *[T.StructField(f"nC_{c}_position_in_m", T.DoubleType()) for c in "xyz"],
        T.StructField("nC_time_in_ns", T.DoubleType()),
        T.StructField("nC_gamma_amount", T.IntegerType()),
        T.StructField("nC_gamma_total_energy_in_keV", T.DoubleType()),
        T.StructField("nC_material_id", T.IntegerType()),
        T.StructField("nC_phys_vol_id", T.IntegerType()),
        *[T.StructField(f"gamma{i}_{c}", T.DoubleType()) for i in range(1, 5) for c in ("E", "px", "py", "pz")],
        T.StructField("nC_flag_Ge77", T.BooleanType()),
    ]
)
RAW_OPTICAL = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("evtid", T.LongType()),
        T.StructField("nC_track_id", T.LongType()),
        T.StructField("det_uid", T.IntegerType()),
        *[T.StructField(f"{c}_position_in_m", T.FloatType()) for c in "xyz"],
        *[T.StructField(f"{c}_momentum_direction", T.FloatType()) for c in "xyz"],
        T.StructField("photon_gamma_kinetic_energy_in_keV", T.DoubleType()),
        T.StructField("time_in_ns", T.DoubleType()),
    ]
)
#: Names of file-local ids; of repeated ids the later row counts.
LOCAL_NAMES = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("row_ix", T.LongType()), T.StructField("local_id", T.IntegerType()), T.StructField("name", T.StringType())])
VOXEL = T.StructType(
    [
        T.StructField("index", T.StringType()),
        T.StructField("center", T.ArrayType(T.DoubleType())),
        T.StructField("corners", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("layer", T.StringType()),
    ]
)
#: Order of the 30 feature columns of the training set.
PHI = (
    ["xNC_mm", "yNC_mm", "zNC_mm", "matID", "volID", "#gamma", "E_gamma_tot_keV", "r_NC_mm", "phi_NC_rad"]
    + ["dist_to_wall_mm", "dist_to_bot_mm", "dist_to_top_mm", "p_mean_r", "p_mean_z"]
    + [name.format(i) for i in range(1, 5) for name in ("gammaE{}_keV", "gammapx{}", "gammapy{}", "gammapz{}")]
)
