"""hitlake.streaming"""
