"""hitlake.sources"""
