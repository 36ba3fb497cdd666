"""Classes of feature types. Comparison is case-sensitive, as types are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names under which each class of feature appears.
MRNA = ["mRNA", "messenger RNA", "messenger_RNA"]
UTR5 = ["5' UTR", "5'UTR", "five prime UTR", "five_prime_UTR", "five prime untranslated region", "five_prime_untranslated_region"]
UTR3 = ["3' UTR", "3'UTR", "three prime UTR", "three_prime_UTR", "three prime untranslated region", "three_prime_untranslated_region"]
NAMES = {
    "cds": ["CDS", "coding sequence", "coding_sequence"],
    "exon": ["exon"],
    "gene": ["gene"],
    "intron": ["intron"],
    "mrna": MRNA,
    "pseudogene": ["pseudogene"],
    "start_codon": ["start_codon", "start codon", "initiation codon"],
    "stop_codon": ["stop_codon", "stop codon"],
    "transcript": [*MRNA, "tRNA", "transfer RNA", "rRNA", "ribosomal RNA"],
    "utr": ["UTR", "untranslated region", "untranslated_region", *UTR3, *UTR5],
    "utr3p": UTR3,
    "utr5p": UTR5,
}
#: Types of transcripts and segments that carry accessions of their own.
TRANSCRIPTS = [
    "mRNA", "tRNA", "rRNA", "transcript", "primary_transcript", "ncRNA", "miRNA", "snRNA", "snoRNA", "lnc_RNA", "scRNA", "SRP_RNA", "antisense_RNA", "RNase_P_RNA", "telomerase_RNA",
    "piRNA", "RNase_MRP_RNA", "guide_RNA", "antisense_lncRNA", "transcript_region", "miRNA_primary_transcript",
]
SEGMENTS = ["V_gene_segment", "D_gene_segment", "J_gene_segment", "C_gene_segment"]


def is_a(kind: str, column: str = "type") -> Column:
    return F.col(column).isin(*NAMES[kind])
