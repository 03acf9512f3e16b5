"""The queries of this subpackage, by the names under which they are run."""

from docloom.llm.alignment import op12_alignment
from docloom.llm.divergence import SQL as DIVERGENCE_SQL
from docloom.llm.divergence import op13_divergence
from docloom.llm.fingerprint import op9_fingerprint
from docloom.llm.html_text import op10_html_text
from docloom.llm.image_copies import op5_image_copies
from docloom.llm.jaccard_join import op6_jaccard_join
from docloom.llm.language import op11_language
from docloom.llm.mixing import op8_mixing
from docloom.llm.piece_codec import op2_piece_codec
from docloom.llm.quality import op1_quality
from docloom.llm.sharding import op4_sharding
from docloom.llm.token_counts import op7_token_counts
from docloom.llm.toxicity import op3_toxicity

QUERIES = {
    "op1_quality": op1_quality,
    "op2_piece_codec": op2_piece_codec,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_image_copies": op5_image_copies,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_mixing": op8_mixing,
    "op9_fingerprint": op9_fingerprint,
    "op10_html_text": op10_html_text,
    "op11_language": op11_language,
    "op12_alignment": op12_alignment,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL: dict[str, str] = {"op13_divergence": DIVERGENCE_SQL}
