"""File formats by their first bytes."""

from __future__ import annotations

import zlib

from . import bgzf


def detect_format(head: bytes) -> tuple[str, str]:
    """(format, compression) of a file that begins with ``head``."""
    compression = "none"
    if head[:2] == b"\x1f\x8b":
        compression = "bgzf" if bgzf.block_size(head) else "gzip"
        try:
            head = zlib.decompressobj(31).decompress(head)
        except zlib.error:
            return "unknown", compression
    for magic, name in ((b"BAM\1", "bam"), (b"BCF\2", "bcf"), (b"BCF\4", "bcf"), (b"CRAM", "cram"), (b"BAI\1", "bai"), (b"CSI\1", "csi"), (b"TBI\1", "tbi"), (b"##fileformat=VCF", "vcf"), (b"@HD\t", "sam"), (b"@SQ\t", "sam"), (b"@RG\t", "sam"), (b"@PG\t", "sam"), (b"@CO\t", "sam")):
        if head.startswith(magic):
            return name, compression
    text = head.split(b"\n", 1)[0]
    if text.startswith(b">"):
        return "fasta", compression
    if text.startswith(b"@"):
        return "fastq", compression
    cells = text.split(b"\t")
    if len(cells) == 6 and cells[5][:1] in b"+-*" and not cells[3].strip(b"01"):
        return "mhap", compression
    if len(cells) >= 11 and cells[1].isdigit() and cells[3].isdigit():
        return "sam", compression
    if len(cells) >= 3 and cells[1].isdigit() and cells[2].isdigit():
        return "bed", compression
    return ("empty" if not head else "unknown"), compression
