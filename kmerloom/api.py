"""The k-mer part in one place."""

from __future__ import annotations

from .functions.dna import canonical, check_k, check_m, code, decode, digits, letters, reverse_complement
from .functions.hashing import HashWindow, kmer_hash, minimizer_partition
from .operators.combining import Run, aggregate, combine, counts_run
from .operators.counting import count_kmers, explode_kmers, hard_min, histogram, histogram_totals, saturate, to_slots
from .operators.filtering import absent_from_matrix, key_vector, rows_in_key
from .operators.merging import apply_batches, apply_plugin, count_matrix, float_thresholds, merge_counts, merge_statistics, observed, solidify
from .operators.partitioning import partition_sizes, restrict, static_repartition, super_kmers, with_minimizer, with_partition
from .operators.reshaping import bloom_matrix, cardinalities, counting_bloom_matrix, false_positive_rates, per_sample_filters, presence, sample_vectors, text_lines, vector_slots
from .plans.commands import aggregate_run, combine_runs, filter_run, partition_info
from .plans.pipeline import MODES, STAGES, Options, run, run_sheet
from .sources.alignments import keep_alignments, read_bam
from .sources.kff import kff_files, read_kff, write_files
from .sources.reads import read_fasta, read_fastq, read_samples, read_sequences, read_sheet, read_thresholds
from .sources.store import RunStore

__all__ = [
    "MODES", "STAGES", "HashWindow", "Options", "Run", "RunStore", "absent_from_matrix", "aggregate", "aggregate_run", "apply_batches",
    "apply_plugin", "bloom_matrix", "canonical", "cardinalities", "check_k", "check_m", "code", "combine", "combine_runs", "count_kmers",
    "count_matrix", "counting_bloom_matrix", "counts_run", "decode", "digits", "explode_kmers", "false_positive_rates", "filter_run",
    "float_thresholds", "hard_min", "histogram", "histogram_totals", "infos", "keep_alignments", "key_vector", "kff_files", "kmer_hash", "letters",
    "merge_counts", "merge_statistics", "observed", "minimizer_partition", "partition_info", "partition_sizes", "per_sample_filters", "presence", "read_bam",
    "read_fasta", "read_fastq", "read_kff", "read_samples", "read_sequences", "read_sheet", "read_thresholds", "restrict", "reverse_complement",
    "rows_in_key", "run", "run_sheet", "sample_vectors", "saturate", "solidify", "static_repartition", "super_kmers", "text_lines", "to_slots",
    "vector_slots", "with_minimizer", "with_partition", "write_files",
]


def infos() -> dict:
    """Versions and limits."""
    import pyspark

    from . import __version__
    from .functions import dna

    return {"version": __version__, "pyspark": pyspark.__version__, "k": (dna.MIN_K, dna.MAX_K), "minimizer": (dna.MIN_M, dna.MAX_M), "modes": MODES}
