"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from accord.llm import warc
from accord.llm.bilinear import op5_bilinear_scores
from accord.llm.mixing import op10_mixture
from accord.llm.near_duplicates import op3_near_duplicates
from accord.llm.nn_descent import op1_nearest_neighbours
from accord.llm.packed_ids import op6_packed_ids
from accord.llm.piecewise import op4_piecewise_hashes
from accord.llm.pieces_bpe import op7_piece_encoding
from accord.llm.sanitise import op2_sanitise
from accord.llm.toxicity import op9_toxicity
from accord.llm.warc import op8_warc_revisits

QUERIES = {
    f.__name__: f
    for f in (
        op1_nearest_neighbours,
        op2_sanitise,
        op3_near_duplicates,
        op4_piecewise_hashes,
        op5_bilinear_scores,
        op6_packed_ids,
        op7_piece_encoding,
        op8_warc_revisits,
        op9_toxicity,
        op10_mixture,
    )
}

#: What SQL can say; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op8_warc_revisits": warc.ORACLE}
