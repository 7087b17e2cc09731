"""Checklists: rows of fields, each with a type, a gate and keywords. Any list of Field works; STARTER is one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    field_id: str
    type: str
    dimension: str | None = None
    low: float | None = None
    high: float | None = None
    enum_values: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()
    sensitivity: str = "HIGH"
    canonical_unit: str | None = None
    provenance: tuple[tuple[tuple[str, str], ...], ...] = ()
    sensitivity_source: str = "default"
    description: str = ""

    def keywords(self) -> list[tuple[str, int]]:
        """Parts of the id, weight 2; the joined word for cell lines stands for two phrases of weight 1."""
        out: list[tuple[str, int]] = []
        for part in self.field_id.replace("_", ".").split("."):
            out += [("cell line", 1), ("cell lines", 1)] if part == "cellline" else [(part, 2)]
        return out


_ANIMALS, _XENO, _CELLS, _DRUG, _QPCR, _WET = ("has_animals",), ("has_xenograft",), ("has_cell_lines",), ("has_drug_treatment",), ("has_qpcr",), ("has_wet_lab",)

# The starter checklist, version 0.2-starter.
VERSION = "0.2-starter"
STARTER = (
    Field("animal.species", "enum", enum_values=("Mus musculus", "Rattus norvegicus", "other"), all_of=_ANIMALS),
    Field("animal.strain", "identifier", all_of=_ANIMALS),
    Field("animal.sex", "enum", enum_values=("male", "female", "both", "not_stated"), all_of=_ANIMALS),
    Field("animal.age_or_weight", "quantity", "time_or_mass", all_of=_ANIMALS, sensitivity="MED"),
    Field("animal.ethics_approval", "identifier", all_of=_ANIMALS, sensitivity="LOW"),
    Field("animal.sample_size_justification", "text", all_of=_ANIMALS, sensitivity="MED"),
    Field("animal.humane_endpoint", "quantity", "volume", all_of=_XENO, sensitivity="MED", canonical_unit="mm3"),
    Field("xenograft.cell_number", "quantity", "count", 1e4, 1e8, all_of=_XENO, canonical_unit="cells"),
    Field("xenograft.injection_site", "enum", enum_values=("subcutaneous_flank", "orthotopic", "intravenous", "intraperitoneal", "other"), all_of=_XENO),
    Field("xenograft.tumour_measurement_method", "text", all_of=_XENO),
    Field("cellline.name", "identifier", all_of=_CELLS),
    Field("cellline.source_or_rrid", "identifier", all_of=_CELLS),
    Field("cellline.authentication", "text", all_of=_CELLS, sensitivity="MED"),
    Field("cellline.mycoplasma", "boolean", all_of=_CELLS, sensitivity="LOW"),
    Field("cellline.passage_number", "quantity", "count", all_of=_CELLS, sensitivity="MED"),
    Field("culture.temperature", "quantity", "temperature", 293.15, 315.15, all_of=_CELLS, canonical_unit="K"),
    Field("culture.co2_fraction", "quantity", "fraction", 3.0, 10.0, all_of=_CELLS, sensitivity="MED", canonical_unit="percent"),
    Field("treatment.concentration", "quantity", "concentration", all_of=_DRUG, canonical_unit="mol/L"),
    Field("treatment.duration", "quantity", "time", all_of=_DRUG, canonical_unit="s"),
    Field("treatment.vehicle", "text", all_of=_DRUG, sensitivity="MED"),
    Field("qpcr.primer_sequences", "sequence", all_of=_QPCR),
    Field("qpcr.reference_genes", "identifier", all_of=_QPCR),
    Field("stats.replicate_type", "enum", enum_values=("biological", "technical", "both", "not_stated")),
    Field("stats.test_named", "text"),
    Field("assay.protocol_parameters", "text", all_of=_WET),
    Field("centrifugation.force", "quantity", "relative_centrifugal_force", 100.0, 200000.0, all_of=_WET, canonical_unit="g_rcf"),
    Field("antibody.identifier", "identifier", all_of=_WET, any_of=("has_western_blot", "has_ihc", "has_flow_cytometry")),
)


def pack_frame(spark: SparkSession, pack: tuple[Field, ...] = STARTER) -> DataFrame:
    schema = "canonical_unit string, field_ordinal int, field_id string, type string, dimension string, low double, high double, enum_values array<string>, all_of array<string>, any_of array<string>, sensitivity string"
    return spark.createDataFrame([(f.canonical_unit, i, f.field_id, f.type, f.dimension, f.low, f.high, list(f.enum_values), list(f.all_of), list(f.any_of), f.sensitivity) for i, f in enumerate(pack)], schema)


def keyword_frame(spark: SparkSession, pack: tuple[Field, ...] = STARTER) -> DataFrame:
    return spark.createDataFrame([(f.field_id, w, n) for f in pack for w, n in f.keywords()], "field_id string, keyword string, weight int")


def by_id(pack: tuple[Field, ...], field_id: str) -> Field | None:
    """The first field of that id."""
    return next((f for f in pack if f.field_id == field_id), None)
