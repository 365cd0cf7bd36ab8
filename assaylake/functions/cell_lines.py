"""Names of cell lines: which are primary cells, and the one name that spellings of a line stand for.

The two tables are of two kinds of assays and disagree in places; each is applied by its own rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches_any

#: Patterns of names of primary cells and of lines that are in no catalogue.
PRIMARY = [
    r"primary.*hepatocyte", r"hepatocyte.*primary", r"mouse hepatocyte", r"hPHH", r"PHH", r"cryopreserved.*hepatocyte", r"HepatoPac", r"iPSC", r"IPS.*cell",
    r"IPS.*neuron", r"iCell", r"ReproNeuro", r"HUVEC", r"primary.*cell", r"primary.*neuron", r"primary.*culture", r"human primary", r"mouse primary", r"rat primary",
    r"transgenic.*hepatocyte", r"^CD4.*T.*cell", r"T-reg", r"^T-cell", r"hSKMC", r"hSKMc", r"HSMM", r"human.*tendon", r"differentiated.*adipocyte", r"^GM\d{4,5}",
    r"^GMO\d{4,5}", r"^F\d{2}-\d{3}", r"^SCA\d+-\d+", r"DM1 fibroblast", r"Steinert DM1", r"^HBE[s]?$", r"^3T3", r"NIH 3T3", r"^4T1$", r"^AML12$", r"^B16", r"^EMT-6$",
    r"^HEPA 1-6$", r"^MH-S$", r"^P388D1$", r"^RAW 264", r"^TCMK", r"^b\.END$", r"BACHD", r"^COS-7$", r"^LLC-MK", r"^NRK$", r"^Vero", r"^4MBr", r"^HEK.*\(", r"HEK-SORT1",
    r"GLP1R HEK", r"^HepAD38$", r"^HepG2\.2\.15$", r"^HepaRG$", r"Angelman.*neuron", r"Ube3a.*neuron", r"Ube3a.*YFP", r"human neuron", r"^ThioMac$",
]
#: Spellings of in-vitro assays.
IN_VITRO = {
    "HepG2.2.15": "HepG2.2.15", "HepG2": "HepG2", "A431": "A431", "A-431": "A431", "A-549": "A549", "A549": "A549", "A459": "A549", "Hep3B": "Hep3B", "HepB3": "Hep3B",
    "SH-SY5Y": "SH-SY5Y", "SH-SY-5Y": "SH-SY5Y", "SK-MEL-28": "SK-MEL-28", "T-24": "T24", "T24": "T24", "HuVEC": "HUVEC", "HUVEC": "HUVEC", "LNCaP": "LNCaP",
    "U251": "U251", "iCell cardiomyocytes": "iCell cardiomyocytes", "iCell cardiomyocytes2": "iCell cardiomyocytes", "VCaP": "VCaP",
    "iCell GABANeurons": "iCell GABANeurons", "Huh7": "Huh7", "HepaRG": "HepaRG", "THP-1": "THP-1", "MM.1R": "MM.1R", "SNU-449": "SNU-449", "54-2": "54-2",
    "LLC-MK2": "LLC-MK2", "K-562": "K-562", "hSKMc": "hSKMc", "hSKMC": "hSKMc", "hSKM": "hSKMc", "HepAD38": "HepAD38", "primary hepatocytes": "primary hepatocytes",
    "primary human hepatocytes": "primary human hepatocytes", "primary transgenic mouse hepatocytes": "primary transgenic mouse hepatocytes",
    "primary hamster hepatocytes": "primary hamster hepatocytes", "primary rabbit hepatocytes": "primary rabbit hepatocytes",
    "primary mouse hepatocytes": "primary mouse hepatocytes", "mouse primary hepatocytes": "mouse primary hepatocytes",
    "Mouse primary hepatocyte": "mouse primary hepatocytes", "mouse primary hepatocyte": "mouse primary hepatocytes",
    "mouse primary hepatocyte cells": "mouse primary hepatocytes", "Rat primary hepatocytes": "rat primary hepatocytes",
    "rat primary hepatocytes": "rat primary hepatocytes", "A172": "A172", "A10": "A10", "HEPA 1-6": "HEPA 1-6", "COS-7": "COS-7", "HeLa": "HeLa", "Hela": "HeLa",
    "3T3-L1": "3T3-L1", "4T1": "4T1", "ReproNeuro Neurons": "ReproNeuro Neurons", "Human IPS cell derived ReproNeuro Neurons": "ReproNeuro Neurons",
    "Primary Cynomolgus hepatocytes": "Primary Cynomolgus hepatocytes", "b.END": "b.END", "bEND": "b.END", "B16-F10": "B16-F10", "MCF7": "MCF7", "PC3": "PC3",
    "P388D1": "P388D1", "EMT-6": "EMT-6", "SW872": "SW872", "Jurkat": "Jurkat", "SKOV3": "SKOV3", "Vero C1008": "Vero C1008", "NRK": "NRK", "HK-2": "HK-2",
    "RAW 264.7": "RAW 264.7", "U266": "U266", "G-361": "G-361", "TCMK-1": "TCMK-1", "Ts 24": "T24",
    "transgenic primary mouse hepatocytes": "primary transgenic mouse hepatocytes", "transgenic mouse primary hepatocytes": "primary transgenic mouse hepatocytes",
    "Transgenic mouse primary hepatocytes": "primary transgenic mouse hepatocytes", "Primary hepatocytes": "primary hepatocytes",
    "Primary rat hepatocytes": "rat primary hepatocytes", "Primary hepatocytes from human apo(a) transgenic mice": "primary hepatocytes",
    "differentiated human adipocytes": "differentiated human adipocytes", "AML12": "AML12",
}
#: Spellings of dose-response assays.
DOSE_RESPONSE = {
    "A431": "A431", "A-431": "A431", "HepG2": "HepG2", "HEPG2": "HepG2", "Hep G2": "HepG2", "HEP-G2": "HepG2", "HepG2s": "HepG2", "Hep3B": "Hep3B", "HepB3": "Hep3B",
    "Hep-3B": "Hep3B", "SH-SY5Y": "SH-SY5Y", "SHSY5Y": "SH-SY5Y", "SH-SY-5Y": "SH-SY5Y", "HUVEC": "HUVEC", "HUVECs": "HUVEC", "HepaRG": "HepaRG", "Heparg": "HepaRG",
    "THP-1": "THP-1", "THP1": "THP-1", "SK-MEL-28": "SK-MEL-28", "SKMEL28": "SK-MEL-28", "A549": "A549", "Huh7": "Huh7", "HUH-7": "Huh7",
    "iCell cardiomyocytes2": "iCell cardiomyocytes2", "iCell cardiomyocytes": "iCell cardiomyocytes", "primary hepatocytes": "primary hepatocytes",
    "Primary hepatocytes": "primary hepatocytes", "SUP-M2": "SUP-M2", "SUPM2": "SUP-M2", "MM.1R": "MM.1R", "MM1R": "MM.1R", "U251": "U251", "U-251": "U251",
    "U251-MG": "U251-MG", "iCell GABANeurons": "iCell GABANeurons", "iCell GABA Neurons": "iCell GABANeurons", "HepG2.2.15": "HepG2.2.15", "HEPG2.2.15": "HepG2.2.15",
    "LLC-MK2": "LLC-MK2", "LLCMK2": "LLC-MK2", "VCaP": "VCaP", "GM04281": "GM04281", "transgenic mouse primary hepatocytes": "transgenic mouse primary hepatocytes",
    "primary mouse hepatocytes": "primary mouse hepatocytes", "SNU-449": "SNU-449", "SNU449": "SNU-449", "HEK293": "HEK293", "HEK-293": "HEK293", "GM02171": "GM02171",
    "Primary human hepatocytes": "Primary human hepatocytes", "primary human hepatocytes": "Primary human hepatocytes", "54-2": "54-2",
    "cynomolgus primary hepatocytes": "cynomolgus primary hepatocytes", "hSKMC": "hSKMC", "GM02173B": "GM02173B", "b.END": "b.END", "bEND": "b.END",
    "mouse primary hepatocytes": "mouse primary hepatocytes", "4T1": "4T1", "MDA-MB-436": "MDA-MB-436", "MDA MB 436": "MDA-MB-436", "CD4 T-cells": "CD4 T-cells",
    "CD4+ T-cells": "CD4+ T-cells", "Human CD4+ T-cells": "CD4+ T-cells", "Angelman IPS-derived neurons": "Angelman IPS-derived neurons",
    "primary rat hepatocytes": "primary rat hepatocytes", "LNCaP": "LNCaP", "T-reg": "T-reg", "KARPAS-229": "KARPAS-229", "SK-BR-3": "SK-BR-3", "SKBR3": "SK-BR-3",
    "SCA2-04": "SCA2-04", "K-562": "K-562", "K562": "K-562", "HeLa": "HeLa", "hela": "HeLa", "C4-2B": "C4-2B", "C4-2": "C4-2", "KMS11": "KMS11",
    "HepatoPac": "HepatoPac", "HSMM": "HSMM", "NCI-H460": "NCI-H460", "NCIH460": "NCI-H460", "HBE": "HBE", "T-24": "T-24", "A10": "A10",
    "cynomolgus monkey primary hepatocytes": "cynomolgus monkey primary hepatocytes", "cyno monkey primary hepatocytes": "cynomolgus monkey primary hepatocytes",
    "DM1 fibroblast": "DM1 fibroblast", "Steinert DM1": "Steinert DM1", "Rhesus monkey primary hepatocytes": "Rhesus monkey primary hepatocytes",
    "human tendon cells": "human tendon cells", "GM04022": "GM04022", "RAW 264.7": "RAW 264.7", "RAW264.7": "RAW 264.7", "C4-2B MR": "C4-2B MR",
    "MDA-MB-231": "MDA-MB-231", "MDA MB 231": "MDA-MB-231", "BACHD mouse hepatocytes": "BACHD mouse hepatocytes", "BACHD": "BACHD", "MH-S": "MH-S", "SCC25": "SCC25",
    "SCC-25": "SCC25", "SW872": "SW872", "B16-F10": "B16-F10", "B16F10": "B16-F10", "F09-152": "F09-152", "F09-229": "F09-229",
    "Ube3a-YFP primary neurons": "Ube3a-YFP primary neurons", "Ube3a-YFP primary neuronal cultures": "Ube3a-YFP primary neuronal cultures",
    "Primary neuronal cultures": "Primary neuronal cultures", "GM04478": "GM04478", "PiZ primary hepatocytes": "PiZ primary hepatocytes", "Ube3a-YFP": "Ube3a-YFP",
    "A172": "A172", "H929": "H929", "IPS-cell derived neurons": "IPS-cell derived neurons", "U266": "U266", "NIH 3T3": "NIH 3T3", "3T3-L1": "3T3-L1", "4MBr-5": "4MBr-5",
    "Vero C1008": "Vero C1008", "CaCo-2": "CaCo-2", "Caco2": "CaCo-2", "U87MG": "U87MG", "MCF7": "MCF7", "U2932": "U2932",
    "primary rabbit hepatocytes": "primary rabbit hepatocytes", "primary hamster hepatocytes": "primary hamster hepatocytes", "SCC-4": "SCC-4", "Granta519": "Granta519",
    "Mino": "Mino", "primary monkey hepatocytes": "primary monkey hepatocytes", "Z138": "Z138", "mouse hepatocytes": "mouse hepatocytes", "CWR22-RV1": "CWR22-RV1",
    "PC9": "PC9", "CAL33": "CAL33", "MAVER1": "MAVER1", "BICR56": "BICR56", "JVM2": "JVM2", "CAL27": "CAL27", "COS-7": "COS-7", "Detroit-562": "Detroit-562",
    "UPCI:SCC090": "UPCI:SCC090", "NCI-H747": "NCI-H747", "BICR-22": "BICR-22", "NCI-H292": "NCI-H292", "SCC-9": "SCC-9", "Colo201": "Colo201", "SNU-899": "SNU-899",
    "SNU-1214": "SNU-1214", "SCC-15": "SCC-15", "SNU-1076": "SNU-1076", "SNU-1066": "SNU-1066", "HEK-SORT1": "HEK-SORT1", "GLP1R HEK": "GLP1R HEK",
    "primary murine hepatocytes": "primary murine hepatocytes", "ThioMac": "ThioMac", "BT474M1": "BT474M1",
}


def _bare(name: str, signs: str) -> str:
    return name.lower().translate({ord(s): None for s in signs})


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def is_primary(name: Column) -> Column:
    return F.coalesce(matches_any(name, PRIMARY), F.lit(False))


def in_vitro(name: Column) -> Column:
    """The line that a spelling stands for; the name as it is where none is known. Of two spellings alike the later counts."""
    table = {_bare(k, "- ."): v for k, v in IN_VITRO.items()}
    key = F.translate(F.lower(F.trim(F.translate(name, "\u2013_", "--"))), "- .", "")
    return F.coalesce(_looked_up(table, key), name)


def dose_response(name: Column) -> Column:
    """The line that a spelling stands for; the trimmed name where none is known. Of two spellings alike the earlier counts."""
    table: dict[str, str] = {}
    for k, v in DOSE_RESPONSE.items():
        table.setdefault(_bare(k, "- .+"), v)
    own = F.trim(name)
    return F.coalesce(_looked_up(table, F.translate(F.lower(own), "- .+", "")), own)
