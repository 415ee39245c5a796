"""Signal qualification on Spark: public signals in, gated and explained shortlists out."""

from signalsieve.config import MODES, SEED_LEXICON, Phrase, ScoringConfig

__all__ = ["MODES", "SEED_LEXICON", "Phrase", "ScoringConfig"]
