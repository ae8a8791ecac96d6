"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import oracle
from .bitplanes import op11_bitplanes
from .decontaminate import op8_decontaminate
from .langid import op5_langid
from .linededup import op7_linededup
from .ngram import op3_ngram
from .packing import op10_packing
from .pagetext import op9_pagetext
from .prefixjoin import op13_prefixjoin
from .repetition import op6_quality
from .secrets import op1_secrets
from .simhash import op2_simhash
from .substrings import op4_substrings
from .whitening import op12_whitening

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_ngram": op3_ngram,
    "op4_substrings": op4_substrings,
    "op5_langid": op5_langid,
    "op6_quality": op6_quality,
    "op7_linededup": op7_linededup,
    "op8_decontaminate": op8_decontaminate,
    "op9_pagetext": op9_pagetext,
    "op10_packing": op10_packing,
    "op11_bitplanes": op11_bitplanes,
    "op12_whitening": op12_whitening,
    "op13_prefixjoin": op13_prefixjoin,
}

# The others have no SQL form (hash functions, learned models, suffix arrays, HTML, tokenizers): tests hold them against plain versions.
ORACLE = {
    "op1_secrets": oracle.secrets_sql(),
    "op7_linededup": oracle.linededup_sql(),
    "op8_decontaminate": oracle.decontaminate_sql(),
    "op11_bitplanes": oracle.bitplanes_sql(),
}
