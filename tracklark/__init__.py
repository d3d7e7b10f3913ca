"""Cue points and loops for whole music catalogues, as Spark jobs."""
