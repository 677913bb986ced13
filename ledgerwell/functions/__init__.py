"""Part of ledgerwell; see the README for the layout."""
