"""callweave.plans"""
