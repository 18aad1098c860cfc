"""Relational operators: DataFrame in, DataFrame out, no action unless a docstring says so."""
