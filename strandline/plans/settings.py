"""Years that plans read when they are run, so that a caller may set them; the registered SQL holds for the values here."""

#: The last year of the frozen corpus, the cutoff of features and its horizon, that of self candidates, and the cutoffs of the folds.
FREEZE = 2000
CUTOFF = 1998
HORIZON = 2
SELF_CUTOFF = 1996
CUTOFFS = (1997, 1998, 1999)
