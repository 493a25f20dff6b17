"""Schemas of the relations that scans and operators return."""

from __future__ import annotations

FASTQ_SCHEMA = "path string, record_index bigint, byte_offset bigint, name binary, seq binary, plus binary, qual binary"
#: A FASTQ scan also tells where the third and fourth line start, how many lines the record has (under 4, it is cut short) and what is
#: wrong with it: 1 cut short, 2 header without @, 4 no id, 8 third line without +, 16 lengths differ, or their sum.
FASTQ_SCAN_SCHEMA = FASTQ_SCHEMA + ", plus_offset bigint, qual_offset bigint, n_lines int, faults int"
#: A packing scan adds both structs and the place of the first quality byte outside of Phred+33, from 0; null if there is none.
PACKED_SCHEMA = "struct<bases: binary, n_mask: binary, len: bigint, a: bigint, c: bigint, g: bigint, t: bigint, n: bigint>"
QUALITY_SCHEMA = "struct<len: bigint, min_phred: int, max_phred: int, sum_phred: bigint, q20_bases: bigint, q30_bases: bigint>"
FASTQ_PACKED_SCHEMA = f"{FASTQ_SCAN_SCHEMA}, packed {PACKED_SCHEMA}, quality {QUALITY_SCHEMA}, bad_phred int"
FASTA_SCHEMA = "path string, record_index bigint, byte_offset bigint, name binary, seq binary"
FASTA_SCAN_SCHEMA = FASTA_SCHEMA + ", n_lines int"
LINE_SCHEMA = "path string, line_no bigint, byte_offset bigint, width bigint, line binary"
ERROR_SCHEMA = "struct<kind: string, message: string, byte_offset: bigint, record_index: bigint, line_index: int>"
BGZF_INDEX_SCHEMA = "path string, block_index bigint, compressed_offset bigint, uncompressed_offset bigint, compressed_size bigint, uncompressed_size bigint"
