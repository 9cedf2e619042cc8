"""Column functions: names, sequences, CIGAR, flags, tags and variant fields."""
from strandlake.functions.cigar import (aligned_blocks, cigar_ops, read_span, ref_span, unclipped_end,
                                        unclipped_start)
from strandlake.functions.flags import (clear_flag, is_duplicate, is_first, is_mapped, is_mate_mapped, is_paired,
                                        is_primary, is_reverse, is_second, mate_number, set_flag)
from strandlake.functions.fields import info_value, tag
from strandlake.functions.naming import interleaved_name, is_mate_file, mate_suffix, sample_id, strip_mate
from strandlake.functions.sequence import forward_quals, forward_sequence, phred, revcomp, to_quals
from strandlake.functions.variants import variant_class

__all__ = [
    "aligned_blocks", "cigar_ops", "read_span", "ref_span", "unclipped_end", "unclipped_start",
    "clear_flag", "is_duplicate", "is_first", "is_mapped", "is_mate_mapped", "is_paired", "is_primary",
    "is_reverse", "is_second", "mate_number", "set_flag", "info_value", "tag", "interleaved_name",
    "is_mate_file", "mate_suffix", "sample_id", "strip_mate", "forward_quals", "forward_sequence", "phred",
    "revcomp", "to_quals", "variant_class",
]
