"""Wording of result tables."""

# Texts of the published test table.
KEPT = "FAIL TO REJECT H0"
REJECTED = "REJECT H0"
LOCATIONS_DIFFER = "REJECT H0 - significant difference between locations"
ANOVA_USED = "One-way ANOVA"
KRUSKAL_CHOSEN = "Kruskal-Wallis H-test (non-parametric, chosen due to non-normality/unequal variance)"
KRUSKAL_USED = "Kruskal-Wallis"
PEARSON_USED = "Pearson correlation"
