from .dna import base_counts, complement_char, gc_content, iupac_class, iupac_matches, n_fraction, protein_signal, reverse_complement
from .listing import mean, median, min_max, n50, nx, percentile
from .quality import arithmetic_mean_quality, count_above, err_sum, mean_quality, phred_to_prob, prob_to_phred
from .size import parse_size
from .trim import best_segment, mott_segment

__all__ = [
    "arithmetic_mean_quality", "base_counts", "best_segment", "complement_char", "count_above", "err_sum", "gc_content", "iupac_class", "iupac_matches",
    "mean", "mean_quality", "median", "min_max", "mott_segment", "n50", "n_fraction", "nx", "parse_size", "percentile", "phred_to_prob", "prob_to_phred",
    "protein_signal", "reverse_complement",
]
