"""Schemas of the application tables and the alignment flag bits."""

HAPLOTYPE = "chr string, beg bigint, end bigint, hap string, cnt int, strand string"
SITE = "chr string, pos bigint, end bigint"
REGION = "ord bigint, chr string, beg bigint, end bigint"
ALIGNMENT = "ord bigint, qname string, flag int, chr string, pos bigint, mapq int, cigar string, mchr string, mpos bigint, tlen bigint, seq string, qual string, aux map<string,string>"
SUMMARY_COLUMNS = ["Chr", "Start", "End", "Strand", "nReads", "mBase", "tBase", "cBase", "K4plus", "nDR", "nMR"]

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
FLAG_NAMES = ["PAIRED", "PROPER_PAIR", "UNMAP", "MUNMAP", "REVERSE", "MREVERSE", "READ1", "READ2", "SECONDARY", "QCFAIL", "DUP", "SUPPLEMENTARY"]
#: Reads with any of these bits are not used.
EXCLUDED = UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE | SUPPLEMENTARY
