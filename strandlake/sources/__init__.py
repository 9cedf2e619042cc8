"""Readers and writers for FASTQ, FASTA, SAM, VCF and the Parquet stores."""
