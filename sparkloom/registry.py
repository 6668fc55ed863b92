"""Task registry, prompt placeholders and family routing as plain data and small DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Task groups and their tasks.
TASKS = {
    "Tox": ["hERG_Karim", "Carcinogens_Lagunin", "Skin_Reaction", "hERG", "AMES", "DILI", "ClinTox"],
    "ADME": [
        "PAMPA_NCATS", "HIA_Hou", "Bioavailability_Ma", "BBB_Martins", "Pgp_Broccatelli", "CYP1A2_Veith", "CYP2C19_Veith",
        "CYP2C9_Veith", "CYP2D6_Veith", "CYP3A4_Veith", "CYP2C9_Substrate_CarbonMangels", "CYP2D6_Substrate_CarbonMangels",
        "CYP3A4_Substrate_CarbonMangels",
    ],
    "HTS": [
        "cav3_t-type_calcium_channels_butkiewicz", "tyrosyl-dna_phosphodiesterase_butkiewicz", "HIV", "SARSCoV2_3CLPro_Diamond",
        "SARSCoV2_Vitro_Touret", "orexin1_receptor_butkiewicz", "m1_muscarinic_receptor_agonists_butkiewicz",
        "m1_muscarinic_receptor_antagonists_butkiewicz", "potassium_ion_channel_kir2.1_butkiewicz",
        "kcnq2_potassium_channel_butkiewicz", "choline_transporter_butkiewicz", "serine_threonine_kinase_33_butkiewicz",
    ],
    "Develop": ["SAbDab_Chen"],
    "PPI": ["HuRI"],
    "TCREpitopeBinding": ["Weber"],
    "TrialOutcome": ["phase1", "phase2", "phase3"],
    "PeptideMHC": ["MHC1_IEDB-IMGT_Nielsen", "MHC2_IEDB_Jensen"],
}
# Tasks whose loader takes a label, in the order in which they are tried.
SPECIAL = ("ToxCast", "herg_central", "Tox21")
# Family prefixes of a group, in the order in which they are tried; "*x" is a suffix, "=x" the whole name.
FAMILIES = {
    "Tox": ["herg_central", "ToxCast", "Tox21", "Skin_Reaction", "hERG", "AMES", "DILI", "ClinTox"],
    "ADME": TASKS["ADME"],
    "HTS": ["HIV", "SARSCoV2_3CLPro_Diamond", "SARSCoV2_Vitro_Touret", "*butkiewicz"],
    "Develop": ["SAbDab_Chen"],
    "PPI": ["HuRI"],
    "TCREpitopeBinding": ["Weber"],
    "TrialOutcome": ["=phase1", "=phase2", "=phase3"],
    "PeptideMHC": ["MHC1_IEDB-IMGT_Nielsen", "MHC2_IEDB_Jensen"],
}
# Input columns, label column, and (placeholder, tag) pairs by task; None is any other task.
INPUTS = {
    None: (["Drug"], "Y", [("{Drug SMILES}", "SMILES")]),
    "SAbDab_Chen": (["Antibody"], "Y", [("{Antibody heavy chain sequence}", "FASTA"), ("{Antibody light chain sequence}", "FASTA")]),
    "HuRI": (["Protein1", "Protein2"], "Y", [("{Protein1 amino acid sequence}", "FASTA"), ("{Protein2 amino acid sequence}", "FASTA")]),
    "Weber": (["epitope_aa", "tcr"], "label", [("{Epitope amino acid sequence}", "FASTA"), ("{TCR amino acid sequence}", "FASTA")]),
    "PeptideMHC": (["Peptide", "MHC"], "Y", [("{Peptide amino acid sequence}", "FASTA"), ("{Possible MHC pseudosequences}", "FASTA")]),
}
# Placeholders of the regression templates; None is unwrapped.
REGRESSION = {
    "{Target amino acid sequence}": "FASTA", "{Drug1 SMILES}": "SMILES", "{Drug2 SMILES}": "SMILES", "{Cell line description}": None,
    "{Antigen sequence}": "FASTA", "{GuideSeq}": "FASTA", "{Catalyst SMILES}": "SMILES", "{Reactant SMILES}": "SMILES", "{Product SMILES}": "SMILES",
}


def tasks(spark: SparkSession, labels: dict[str, list[str]] | None = None, groups: list[str] | None = None) -> DataFrame:
    """(task_group, task) of the chosen groups (all); `labels` adds tasks of labelled data sets, e.g. {"Tox21": [...]}.

    Of herg_central only the last label counts.
    """
    rows = [(g, t) for g, ts in TASKS.items() for t in ts]
    for name, values in (labels or {}).items():
        values = values[-1:] if name == "herg_central" else values
        rows += [("Tox", f"{name}_{v.replace('-', '_') if name == 'Tox21' else v}") for v in values]
    unknown = set(groups or []) - set(TASKS) - {"all"}
    if unknown:
        raise ValueError(f"unknown task groups: {sorted(unknown)}")
    chosen = set(TASKS) if not groups or "all" in groups else set(groups)
    return spark.createDataFrame([r for r in rows if r[0] in chosen], "task_group string, task string")


def prompt_key(task: Column) -> Column:
    """The key of a task in the template map."""
    plain = F.replace(task, F.lit("-"), F.lit("_"))
    return F.when(task == "Weber", F.lit("weber")).when(task.startswith("herg_central"), F.lit("herg_central")).otherwise(plain)


def loader_label(task: Column) -> Column:
    """The label that the loader of a special task takes, null for other tasks."""
    out = F.lit(None).cast("string")
    for special in reversed(SPECIAL):
        label = F.substring_index(task, f"{special}_", -1)
        label = F.replace(label, F.lit("_"), F.lit("-")) if special == "Tox21" else label
        out = F.when(task.startswith(special), label).otherwise(out)
    return out


def family(group: Column, task: Column) -> Column:
    """The report family of a task: the first matching rule of its group, null if none matches."""
    out = None
    for g, rules in FAMILIES.items():
        for rule in rules:
            name = rule.lstrip("*=")
            hit = task.endswith(name) if rule[0] == "*" else task == name if rule[0] == "=" else task.startswith(name)
            out = (F if out is None else out).when((group == g) & hit, F.lit(name))
    return out
