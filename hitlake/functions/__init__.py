"""hitlake.functions"""
