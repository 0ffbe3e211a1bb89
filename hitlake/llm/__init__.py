"""Training-data operators: one module per operator, each `DataFrame -> DataFrame`.

Nothing else in hitlake imports this subpackage.
"""
