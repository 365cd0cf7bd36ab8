"""The queries of this folder and, where SQL can express one, its SQL."""

from .decontaminate import op2_benchmark_decontamination
from .divergence import OP12_SQL, op12_source_divergence
from .html_extract import op3_html_extraction
from .language_id import op4_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .media import op5_media_columns
from .ngram_join import OP10_SQL, op10_ngram_jaccard_join
from .neighbours import OP11_SQL, op11_nearest_neighbours
from .packing import op7_packing
from .sharding import OP6_SQL, op6_sharding
from .spelling import OP13_SQL, op13_spelling_variants
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .warc import op8_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_benchmark_decontamination,
        op3_html_extraction,
        op4_language_id,
        op5_media_columns,
        op6_sharding,
        op7_packing,
        op8_warc_derivatives,
        op9_line_dedup,
        op10_ngram_jaccard_join,
        op11_nearest_neighbours,
        op12_source_divergence,
        op13_spelling_variants,
    )
}

ORACLE = {"op1_substring_dedup": OP1_SQL, "op6_sharding": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_ngram_jaccard_join": OP10_SQL, "op11_nearest_neighbours": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_spelling_variants": OP13_SQL}
