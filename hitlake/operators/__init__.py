"""hitlake.operators"""
