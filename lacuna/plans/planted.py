"""Documents with the checklist's vocabulary, made from the ids of the documents table: what the test tables' invented prose lacks.

Each text is put together of one choice from every segment; the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILLER = "The plain line of words was written to widen the window. "
#: (divisor, choices): the choice is (doc_id div divisor) mod the number of choices.
SEGMENTS = (
    (1, ("A study of growth\n\nIntroduction\nWe ask what is stated here. Earlier work was long.\n", "Background\nNothing is known of it yet.\n")),
    (1, ("EXPERIMENTAL PROCEDURES\n", "Materials and Methods\n", "2. Methods:\n", "Online Methods\n", "")),
    (1, ("Animals\n", "Cell culture\n", "Animals\nIn vivo treatment\n")),
    (
        1,
        (
            "Female BALB/c mice weighing 20-25 g were kept. The animal protocol was approved by the IACUC of the site. ",
            "A549 and HCT116 cells were cultured at 37 °C in 5% CO2. Cell lines were purchased from ATCC. ",
            "Cells were grown  overnight at room temperature. Mycoplasma was tested and found negative. ",
            "The mouse antibody was used. Rabbit anti-mouse serum was added. ",
            "Rats were fed. The animal sample size was determined by a power analysis. ",
            "MDA-MB-231 cells were injected subcutaneously into the flank. Tumor volume was calculated with calipers. ",
            "5 x 10^6 EC109 cells were injected as a xenograft at passage number 12. ",
        ),
    ),
    (
        1,
        (
            "Samples were spun at a centrifugation force of 12,000 × g for 10 min. ",
            "Samples were spun at high speed for 5 min. ",
            "Samples were spun with a force of 5000 rpm. ",
            "Tubes of B1.5 ml were used in culture at a temperature of 900 °C. ",
            "Cells were treated with a vehicle of DMSO at a concentration of 10 µM for a duration of 24 h. ",
            "Cells were treated with bisulfite as previously described. ",
            "The indicated concentrations of the treatment were used overnight. ",
            "The primer sequences were ACGTACGTACGTACGT and qPCR was run; GAPDH was the reference. ",
            "The culture temperature was 4-8 C. ",
            "The centrifugation force was set according to the manufacturer, briefly. ",
            "Western blot was done with an antibody as described previously. ",
        ),
    ),
    (2, ("\nStatistical analysis\n", "\nProtocol and assay\n", "\n")),
    (
        3,
        (
            "A t-test was used as the test with three biological replicates. ",
            "The replicate type was in triplicate. ",
            "Values were compared. ",
            "The test was named in Table 1; the replicate type is shown in Table 2. ",
            "ANOVA and Tukey were the stats. ",
            "The passage number was 12. Cell number: 12 cells were injected. ",
            "The stats were done as needed. ",
        ),
    ),
    (5, ("", _FILLER * 6, _FILLER * 16)),
    (4, ("\nResults\nMice were seen by flow cytometry. The xenograft grew.\n", "\nReferences\n1. Smith, J. 2020.\n", "")),
)


def planted(spark: SparkSession, sf_dir: str, segments: tuple = SEGMENTS, own: bool = False) -> DataFrame:
    """doc_id (string), text; own: each document's own text follows."""
    pick = lambda step, choices: F.element_at(F.array(*map(F.lit, choices)), (F.floor(F.col("doc_id") / step) % len(choices) + 1).cast("int"))
    last = [F.coalesce("text", F.lit(""))] if own else []
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(*(pick(*s) for s in segments), *last).alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def planted_sql(segments: tuple = SEGMENTS, own: bool = False) -> str:
    """SELECT of the same rows."""
    pick = lambda step, choices: f"([{', '.join(map(quoted, choices))}])[(doc_id // {step}) % {len(choices)} + 1]"
    last = " || coalesce(text, '')" if own else ""
    return f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {' || '.join(pick(*s) for s in segments)}{last} AS text FROM documents"
