"""Run configurations: one dataclass a command, read from flat ``key: value`` files.

A value of ``.`` means the default.  Unknown keys and missing required ones raise.
"""

from __future__ import annotations

import re
from dataclasses import MISSING, dataclass, fields
from pathlib import Path


@dataclass
class GenReads:
    reference: str
    output_prefix: str
    read_length: int = 150
    coverage: float = 10.0
    ploidy: int = 2
    paired: bool = False
    fragment_mean: float | None = None
    fragment_sd: float | None = None
    fragment_model: str | None = None
    mutation_rate: float | None = None
    mutation_model: str | None = None
    error_model: str | None = None
    gc_model: str | None = None
    input_vcf: str | None = None
    target_bed: str | None = None
    adapter: str | None = None
    produce_fastq: bool = True
    produce_bam: bool = False
    produce_vcf: bool = False
    seed: str | None = None
    overwrite: bool = False

    def check(self) -> None:
        _need(self.paired is False or self.fragment_model is not None or None not in (self.fragment_mean, self.fragment_sd), "paired reads need a fragment model, or a mean and a standard deviation")
        _need(self.produce_fastq or self.produce_bam or self.produce_vcf, "at least one output is needed")
        _need(self.adapter is None or re.fullmatch("[ACGT]+", self.adapter), "adapters are of A, C, G and T")
        _need(self.read_length > 0 and self.coverage > 0 and self.ploidy > 0, "lengths, coverage and ploidy are positive")


@dataclass
class FilterReads:
    bed: str
    output_prefix: str
    fastq: str | None = None
    vcf: str | None = None
    overwrite: bool = False

    def check(self) -> None:
        _need(self.fastq or self.vcf, "a FASTQ or a VCF is needed")


@dataclass
class MutationModel:
    reference: str
    vcf: str
    output: str
    bed: str | None = None
    overwrite: bool = False

    def check(self) -> None:
        _need(not self.vcf.endswith((".bcf", ".bcf.gz")), "binary call files are not read")


@dataclass
class ErrorModel:
    fastq: str
    output: str
    bins: str | None = None
    transitions: str | None = None
    max_reads: int | None = None
    overwrite: bool = False


@dataclass
class FragmentModel:
    bam: str
    output: str
    min_reads: int = 2
    overwrite: bool = False


@dataclass
class GcModel:
    bam: str
    reference: str
    output: str
    window: int = 100
    stride: int = 100
    min_windows: int = 1
    overwrite: bool = False


@dataclass
class BamModels:
    bam: str
    reference: str
    output_prefix: str
    min_reads: int = 2
    window: int = 100
    stride: int = 100
    min_windows: int = 1
    overwrite: bool = False


@dataclass
class CompareVcfs:
    reference: str
    golden: str
    called: str
    output_prefix: str
    target_bed: str | None = None
    mutation_bed: str | None = None
    aliases: str | None = None
    window: int = 50
    fast: bool = False
    include_homs: bool = False
    overwrite: bool = False

    def check(self) -> None:
        _need(not any(x.endswith((".bcf", ".bcf.gz")) for x in (self.golden, self.called)), "binary call files are not read")


@dataclass
class CancerReads:
    reference: str
    output_prefix: str
    purity: float
    coverage: float
    normal_rate: float = 0.001
    tumor_rate: float = 0.0001
    read_length: int = 150
    seed: str | None = None
    overwrite: bool = False

    def check(self) -> None:
        _need(0 < self.purity < 1, "purity lies between 0 and 1")


def _need(ok, why: str) -> None:
    if not ok:
        raise ValueError(why)


def _cast(text: str, kind: str):
    if "bool" in kind:
        _need(text.lower() in ("true", "false"), f"true or false, not {text}")
        return text.lower() == "true"
    return int(text) if "int" in kind else float(text) if "float" in kind else text


def parse(text: str, command: type):
    known = {f.name: f for f in fields(command)}
    got = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"(^|\s)#.*", "", line).strip()
        if not line or line == "---":
            continue
        key, colon, value = line.partition(":")
        _need(colon and key.strip() in known, f"line {n}: unknown key {key.strip()!r}")
        value = value.strip().strip("\"'")
        if value not in (".", ""):
            got[key.strip()] = _cast(value, str(known[key.strip()].type))
    missing = [k for k, f in known.items() if f.default is MISSING and k not in got]
    _need(not missing, f"missing: {', '.join(missing)}")
    out = command(**got)
    if hasattr(out, "check"):
        out.check()
    return out


def load(path: str, command: type):
    return parse(Path(path).read_text(), command)


def mode(overwrite: bool) -> str:
    """Writers refuse to replace files unless told so."""
    return "overwrite" if overwrite else "error"


def filtered_name(path: str) -> str:
    """x.fq.gz or x.vcf with ``filtered`` before the extensions."""
    name = Path(path).name
    stem, dot, rest = name.partition(".")
    return str(Path(path).with_name(f"{stem}.filtered{dot}{rest}"))
