"""hitlake.plans"""
