"""Operators that prepare training text: each works on one text column of a sheet, or on two sheets."""

from .bytepairs import decode_cells, encode_cells
from .lines import repeated_lines
from .manifest import sheet_manifest
from .overlap import first_of_similar, similar_rows
from .packing import pack_cells
from .passages import lookup_passages
from .quality import quality_rules
from .shards import shard_rows
from .spans import repeated_spans
from .spelling import column_words, spelling_variants
from .toxicity import fit, toxicity_scores
from .warc import read_archives, write_archives

__all__ = [
    "column_words", "decode_cells", "encode_cells", "first_of_similar", "fit", "lookup_passages", "pack_cells", "quality_rules", "read_archives",
    "repeated_lines", "repeated_spans", "shard_rows", "sheet_manifest", "similar_rows", "spelling_variants", "toxicity_scores", "write_archives",
]
